import re

import numpy as np
import pytest

from brindle.llm import near_dedup, textkernel
from brindle.llm.near_dedup import NearDuplicates
from brindle.llm.util import Scratch, components


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent=80):
    """(n_shingles, component) by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if i is not None and j is not None and both and 100 * both >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), None if i is None else find(i)) for i, s in sets}


def result(df, p):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, p).collect()}


def corpus(prose, edited):
    rows, n = [], 0

    def add(*texts):
        nonlocal n
        for t in texts:
            rows.append((n, t))
            n += 1

    for s in range(20):
        add(prose(s, 40 + 3 * s))
    base = prose(100, 90)
    add(*(edited(base, s, s % 7) for s in range(40)))  # near copies, some too far
    add(*[prose(101, 30)] * 25)  # copies
    passage = prose(102, 40)
    add(*(f"{prose(200 + s, 40)} {passage}" for s in range(30)))  # one passage in many texts
    long_base = prose(103, 900)
    add(long_base, edited(long_base, 1, 10), edited(long_base, 2, 60))
    chain = prose(104, 120)  # each close to the next, the ends far apart
    for s in range(6):
        add(chain)
        chain = edited(chain, 500 + s, 2)
    add("", None, "  \t\n ", "one", "One", "two words", "TWO\twords", "two  words here", "x " * 300, "éa éb éc éd", "ÉA éb éc éd")
    return rows


@pytest.mark.parametrize("p", [NearDuplicates(width=4), NearDuplicates(width=5, long=3), NearDuplicates(width=4, coordinates=28, rows=2, matches=1, agreeing=9, long=3)])
def test_components_are_those_of_all_pairs(documents, prose, edited, p):
    rows = corpus(prose, edited)
    assert result(documents(rows), p) == brute(rows, p.width)


def test_odd_rows(documents, prose):
    t = prose(1, 50)
    rows = [(5, t), (5, t), (3, t), (None, t), (8, None), (9, ""), (7, "a b c")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(rows), NearDuplicates(width=4)).collect()), key=str)
    n = len(shingle_set(t, 4))
    assert got == sorted([(5, n, 3, False), (5, n, 3, False), (3, n, 3, True), (None, n, None, False), (8, 0, 8, True), (9, 0, 9, True), (7, 1, 7, True)], key=str)


def test_empty_table(documents):
    assert near_dedup.near_duplicates(documents([])).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (40, 2))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for a, b in edges for x in (a, b) if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def test_kernel_against_strings(prose):
    import pyarrow as pa

    texts = [prose(s, s) for s in range(12)] + ["", None, " a  b\tc\x0bd ", "É é x", "a" * 5000, "\x85x\xa0y z"]
    column = pa.array(texts)
    data, offsets = textkernel.column_bytes(column)
    values, begin = textkernel.distinct(*textkernel.shingles(textkernel.hashes(data, *(s := textkernel.spans(data, offsets))[:2]), s[2], 3))
    known = {}
    for i, t in enumerate(texts):
        want = shingle_set(t, 3)
        assert begin[i + 1] - begin[i] == len(want)
        for x in values[begin[i] : begin[i + 1]].tolist():
            known.setdefault(x, set()).add(i)
    for i, t in enumerate(texts):  # texts share hashes as they share shingles
        for j, u in enumerate(texts):
            both = len(set(values[begin[i] : begin[i + 1]].tolist()) & set(values[begin[j] : begin[j + 1]].tolist()))
            assert both == len(shingle_set(t, 3) & shingle_set(u, 3))
    part = column.slice(2, 5)
    assert textkernel.column_bytes(part)[0].tobytes() == "".join(texts[2:7]).encode()


def test_one_doc_id_with_two_texts(documents, prose, edited):
    a, b, c = prose(1, 120), prose(2, 120), prose(3, 120)
    rows = [(5, a), (5, b), (5, b), (7, edited(a, 1, 2)), (8, edited(b, 2, 2)), (9, c), (3, edited(b, 3, 2)), (None, a)]
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(rows)).collect())
    assert got == [(False, 3, 3, True), (False, 5, 3, False), (False, 5, 3, False), (False, 5, 5, True), (False, 7, 5, False), (False, 8, 3, False), (False, 9, 9, True), (True, None, None, False)]


def test_rows_go_and_not_ids(documents, prose, edited):
    a, b, c = prose(1, 120), prose(2, 120), prose(3, 120)
    rows = [(5, a), (5, b), (2, edited(a, 1, 2)), (6, c), (6, c), (6, edited(c, 1, 1)), (7, ""), (7, ""), (8, None), (8, None), (9, "")]
    df = documents(rows)
    out = near_dedup.without_duplicates(df)
    assert out.columns == df.columns and {r._row for r in out.collect()} == {"x"}
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert len(got) == 6 and [x for x in got if x[0] != 6] == sorted([(2, rows[2][1]), (5, b), (7, ""), (8, None), (9, "")], key=str)


def rows_joined(df, key):
    """Rows that the joins on key made when df ran."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if "Join" in kind and node.leftKeys().apply(0).toString().startswith(f"{key}#"):
            out += node.metrics().apply("numOutputRows").value()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in kind:
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("common", [1 << 17, 200, 0])
def test_long_lists_make_each_pair_once(spark, prose, edited, monkeypatch, common):
    monkeypatch.setattr(near_dedup, "COMMON", common)
    base, p = prose(1, 160), NearDuplicates()
    texts = [(100 + s, edited(base, s, 1 + s % 4)) for s in range(120)] + [(900, base), (901, prose(2, 150))]
    sets = {i: shingle_set(t, p.width) for i, t in texts}
    group = lambda i: 0 if i % 3 else i  # noqa: E731  one class of many, and others of one
    size = sum(not group(i) for i in sets)
    members = spark.createDataFrame([(i, group(i), 1 if group(i) else size, len(s)) for i, s in sets.items()], "doc_id long, class long, size long, n long")
    found = near_dedup._long_list_pairs(members, spark.createDataFrame(texts, "doc_id long, text string"), p, Scratch(spark, "test"))
    got = [(r.a, r.b) for r in found.collect()]
    links = {(i, j) for i in sets for j in sets if i < j and group(i) != group(j) and 100 * len(sets[i] & sets[j]) >= p.percent * len(sets[i] | sets[j])}
    assert len(links) > 100 and links <= set(got)
    assert len(got) == len(set(got)) == rows_joined(found, "s")
