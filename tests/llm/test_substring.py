import random

import corpus_pipeline
import pytest

from brindle.llm import substring
from brindle.llm.substring import Settings

from .test_near_dedup import shingle_set


def brute_lines(rows, s=Settings()):
    """{(doc_id, line): (doc_id of its cluster's first line, removed)} by comparing all pairs of lines; rows of distinct doc_id."""
    parts = [(d, p, x, shingle_set(x, s.width)) for d, t in rows if d is not None and t is not None for p, x in enumerate(t.split("\n")) if len(x.split()) >= s.min_words]
    head = list(range(len(parts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(parts)):
        for j in range(i):
            a, b = parts[i][3], parts[j][3]
            both = len(a & b)
            if both and 100 * both >= s.percent * len(a | b):
                x, y = find(i), find(j)
                head[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(parts)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for g in groups.values():
        if len(g) > 1:
            first = min(g, key=lambda i: parts[i][:2])
            out |= {parts[i][:2]: (parts[first][0], i != first) for i in g}
    return out


def brute_runs(rows, s=Settings()):
    """({doc_id: words of runs that repeat earlier ones}, {doc_id: words of other runs that occur again}) by a dictionary of all runs."""
    seen, again, gone, kept = {}, set(), {}, {}
    texts = sorted(r for r in rows if r[0] is not None and r[1] is not None)
    runs = [(d, p, " ".join(w[p : p + s.words])) for d, t in texts for w in [t.lower().split()] for p in range(len(w) - s.words + 1)]
    late = []
    for d, p, x in runs:
        head = seen.setdefault(x, (d, p))
        if head[0] != d or p - head[1] >= s.words:
            again.add(x)
            late.append((d, p))
            gone.setdefault(d, set()).update(range(p, p + s.words))
    late = set(late)
    for d, p, x in runs:
        if x in again and (d, p) not in late:
            kept.setdefault(d, set()).update(range(p, p + s.words))
    return gone, kept


def wrapped(text, n):
    """text in lines of n words."""
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def line_corpus(prose, edited):
    shared, near = prose(900, 60), prose(901, 80)
    rows = [(i, "\n".join(prose(10 * i + k, 15 + 12 * k) for k in range(3))) for i in range(15)]
    rows += [(100 + i, f"{prose(2000 + i, 50)}\n{shared}\n{prose(3000 + i, 50)}") for i in range(8)]
    rows += [(200 + i, f"{edited(near, i, i % 4)}\nshort line") for i in range(10)]
    return rows + [(300, f"{shared}\n{shared}"), (301, None), (302, ""), (303, "short line"), (None, shared), (304, "word " * 40 + "\n" + "word " * 60)]


def run_corpus(prose, edited):
    p, q, r = prose(900, 55), prose(901, 120), prose(902, 400)
    rows = [(i, f"{prose(10 * i, 60)}\n{prose(10 * i + 1, 30)}") for i in range(10)]
    rows += [(20 + i, f"{prose(1000 + i, 20 + i)} {p} {prose(1100 + i, 33)}") for i in range(5)]  # in the middle of lines
    rows += [(30 + i, f"{prose(1200 + i, 20)}\n{wrapped(p, 7 + i)}\n{prose(1300 + i, 25)}") for i in range(5)]  # in short lines
    rows += [(40 + i, f"Été {prose(1400 + i, 9)} {wrapped(edited(q, i, i), 11)} {prose(1500 + i, 9)}") for i in range(4)]
    rows += [(50, f"{p}\n{prose(1, 30)}\n{p.upper()}"), (51, p), (52, "na " * 130), (53, "na " * 60), (54, prose(2, 49)), (55, prose(2, 49)), (56, None), (57, ""), (None, p)]
    rows += [(60 + i, edited(r, i, i % 5)) for i in range(12)]  # near and exact copies
    w = r.split()
    rows += [(80 + i, " ".join(w[10 * i : 10 * i + 60 + 7 * i])) for i in range(20)]  # parts that overlap
    rows += [(76, " ".join(w[200:260] + w[100:190] + w[200:260]))]
    random.Random(1).shuffle(rows)
    return rows


def word_place(text, chars):
    return len(text[:chars].split())


def check(got, rows):
    texts = dict(r for r in rows if r[0] is not None)
    lines, gone, kept = {}, {}, {}
    for r in got:
        part = texts[r.doc_id][r.begin : r.end]
        assert len(part.split()) == r.words and part == part.strip() and r.first_doc_id <= r.doc_id
        if r.unit == "line":
            assert "\n" not in part and (r.doc_id, n := texts[r.doc_id][: r.begin].count("\n")) not in lines
            lines[r.doc_id, n] = (r.first_doc_id, r.removed)
        else:
            at = word_place(texts[r.doc_id], r.begin)
            assert r.words >= 50
            (gone if r.removed else kept).setdefault(r.doc_id, set()).update(range(at, at + r.words))
    assert lines == brute_lines(rows)
    assert (gone, kept) == brute_runs(rows)
    return gone


def test_lines_against_brute_force(documents, prose, edited):
    rows = line_corpus(prose, edited)
    check(substring.repeated_passages(documents(rows)).collect(), rows)


def test_runs_against_brute_force(documents, prose, edited):
    rows = run_corpus(prose, edited)
    got = substring.repeated_passages(documents(rows)).collect()
    gone = check(got, rows)
    assert {21, 24, 30, 34, 41, 50, 51, 52, 53, 61, 76, 85} <= set(gone) and not {r.doc_id for r in got} & {*range(1, 10), 56}


def test_rebuilt_texts(documents, prose, edited):
    rows = run_corpus(prose, edited) + [(d + 1000 if d else d, t) for d, t in line_corpus(prose, edited)]
    df, gone = documents(rows), brute_runs(rows)[0]
    texts = {d: t for d, t in rows if d is not None}
    for (d, line), (_, removed) in brute_lines(rows).items():
        if removed:
            parts = texts[d].split("\n")
            at = sum(len(x.split()) for x in parts[:line])
            gone.setdefault(d, set()).update(range(at, at + len(parts[line].split())))
    out = substring.without_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    for d, t in texts.items():
        left = None if t is None else [w for i, w in enumerate(t.split()) if i not in gone.get(d, ())]
        if d in gone and not left:
            assert d not in got
        elif d in gone:
            assert got[d].text.split() == left and got[d].n_chars == len(got[d].text)
        else:
            assert got[d].text == t
    assert out.where("doc_id is null").count() == sum(d is None for d, _ in rows)


def test_blanks_around_a_cut(documents, prose):
    p = prose(7, 60)
    out = substring.without_repeats(documents([(1, p), (2, f"a {p} b"), (3, f"c\n{p} d"), (4, f"e {p}\n\nf"), (5, f"g\n{p}"), (6, f"{p}\nh"), (7, f"i\n{p}\nj")]), Settings(min_words=1000))
    assert {r.doc_id: r.text for r in out.collect()} == {1: p, 2: "a b", 3: "c\nd", 4: "e\n\nf", 5: "g", 6: "h", 7: "i\nj"}


def test_rows_that_repeat_a_doc_id(documents, prose):
    p, rest = prose(7, 60), prose(8, 60)
    rows = [(5, p), (5, p), (5, f"{p} {rest}"), (9, f"x {p}"), (9, f"x {p}")]
    got = sorted((r.doc_id, r.text) for r in substring.without_repeats(documents(rows), Settings(min_words=1000)).collect())
    assert [x for x in got if x[0] == 9] == [(9, "x"), (9, "x")]
    assert [x for x in got if x[0] == 5] in (sorted([(5, p), (5, p), (5, rest)]), [(5, f"{p} {rest}")])  # texts of one doc_id follow each other in no given order
    assert sorted((r.doc_id, r.removed) for r in substring.repeated_passages(documents([(5, p), (5, p), (9, p)])).where("unit = 'passage'").collect()) == [(5, False), (9, True)]


def test_edges(documents, prose):
    assert substring.repeated_passages(documents([])).collect() == []
    assert substring.without_repeats(documents([])).collect() == []
    assert substring.without_repeats(documents([(1, prose(1, 80))])).count() == 1
    assert Settings().bands * Settings().rows % 7 == 0
    assert (1 - 0.8 ** Settings().rows) ** Settings().bands <= 1e-6
    with pytest.raises(ValueError):
        Settings(words=20)


def test_pipeline_stage_cuts_passages(spark, prose):
    from .test_pipeline import table

    p = prose(900, 60)
    rows = [(1, f"{prose(1, 60)} {p} {prose(2, 60)}"), (2, f"{prose(3, 60)} {p} {prose(4, 60)}"), (3, f"{prose(5, 30)}\n{wrapped(p, 8)}\n{prose(6, 30)}")]
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["repeated_paragraphs"](spark, table(spark, rows), "").collect()}
    assert got == {1: rows[0][1], 2: f"{prose(3, 60)} {prose(4, 60)}", 3: f"{prose(5, 30)}\n{prose(6, 30)}"}
