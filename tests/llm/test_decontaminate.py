import re

from brindle.llm import decontaminate


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def grams(w, width):
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items):
    out = set()
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        width = min(5, len(w))
        want = grams(w, width)
        for d, u in docs:
            hits = len(want & grams(words(u), width))
            if d is not None and 100 * hits >= 80 * len(want):
                out.add((d, i, len(want), hits))
    return out


def test_against_brute_force(spark, documents, prose, edited):
    items = [(i, prose(1000 + i, 6 + 5 * i)) for i in range(20)] + [(50, "only three words"), (51, "word"), (52, ""), (53, None), (None, "no key at all here"), (54, prose(77, 400))]
    docs = [(i, prose(i, 150)) for i in range(30)]
    docs += [(100 + i, f"{prose(i, 60)}\n{t}\n{prose(i + 1, 200)}") for i, t in items[:20]]
    docs += [(200 + i, f"{prose(i, 60)} {edited(t, i, 1 + i // 4)} {prose(i + 1, 20)}") for i, t in items[:20]]
    docs += [(300, "Only, THREE - words!"), (301, "three only words"), (302, None), (303, ""), (None, items[3][1]), (304, "a Word here"), (305, edited(items[-1][1], 3, 9)), (306, edited(items[-1][1], 3, 30))]
    docs += [(400 + i, items[5][1]) for i in range(40)] + [(400, items[5][1])]
    df = spark.createDataFrame([(*x, "t", "w") for x in items], "item_id long, text string, h string, w string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.hits) for r in decontaminate.contaminated(documents(docs), df).collect()}
    assert got == brute(docs, items)
    left = {r.doc_id for r in decontaminate.clean(documents(docs), df).collect()}
    assert left == {d for d, _ in docs} - {g[0] for g in got}


def test_empty_tables(spark, documents, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(documents([(1, prose(1, 20))]), none).collect() == []
    assert decontaminate.contaminated(documents([]), some).collect() == []
    assert decontaminate.clean(documents([(1, "x")]), none).count() == 1


def test_rows_that_repeat_a_doc_id_are_judged_one_by_one(spark, documents, prose):
    items = [(1, prose(1001, 30)), (2, prose(1002, 30))]
    leak = f"{prose(5, 9)} {items[0][1]} {prose(6, 9)}"
    docs = [(7, leak), (7, prose(7, 40)), (7, leak), (7, None), (7, ""), (8, prose(8, 40)), (8, prose(8, 40)), (None, leak), (None, None)]
    left = decontaminate.clean(documents(docs), spark.createDataFrame(items, "item_id long, text string"))
    dirty = {t for _, t in docs if brute([(0, t)], items)}
    want = [(d, t) for d, t in docs if d is None or t not in dirty]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str) and len(want) == 7


def test_plan_is_native(spark, documents):
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert "Python" not in decontaminate.contaminated(documents([(1, "a b c d e f g")]), some)._jdf.queryExecution().executedPlan().toString()
