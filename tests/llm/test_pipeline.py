import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken

from brindle.llm.queries import VOCABULARY

from . import test_decontaminate, test_near_dedup, test_substring
from .conftest import DOCUMENTS
from .test_bpe import other  # noqa: F401


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCUMENTS)


def corpus(prose, edited):
    rng = random.Random(2)
    item = prose(5000, 40)
    rows = [(i, "\n".join(prose(7 * i + k, 60) for k in range(3))) for i in range(40)]
    rows += [(100 + i, edited(rows[i][1].replace("\n", " "), i, 3)) for i in range(10)]
    rows += [(120 + i, rows[i][1]) for i in range(10, 15)]
    rows += [(200 + i, f"{prose(8000 + i, 60)}\n{prose(1, 60)}\n{prose(9000 + i, 60)}") for i in range(6)]
    rows += [(300 + i, f"{prose(6000 + i, 60)}\n{item}\n{prose(7000 + i, 60)}") for i in range(4)]
    junk = [(400 + i, " ".join(x + rng.choice(["***", "###"]) for x in prose(4000 + i, 90).split())) for i in range(30)]
    labels = [(i, 1) for i in range(40)] + [(i, 0) for i, _ in junk[:20]]
    return rows, junk, item, labels


def test_each_stage(spark, prose, edited, tmp_path, other):  # noqa: F811
    rows, junk, item, labels = corpus(prose, edited)
    everything = [*rows, *junk, (None, "no id"), (900, None)]
    table(spark, everything).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = lambda df: {(r.doc_id, r.text) for r in df.collect()}

    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, sf)
    assert good.schema == docs.schema
    got = known(good)
    assert set(rows) <= got and not got & set(junk)

    unique = stage["near_duplicates"](spark, table(spark, rows), sf)
    want = {i for i, _, c in test_near_dedup.brute(rows, 5) if i == c}
    assert {i for i, _ in known(unique)} == want and unique.schema == docs.schema

    kept = [(i, t) for i, t in rows if i in want]
    cut = stage["repeated_paragraphs"](spark, table(spark, kept), sf)
    texts = known(cut)
    gone = test_substring.brute_runs(kept)[0]
    for (d, n), (_, removed) in test_substring.brute_lines(kept).items():
        if removed:
            lines = dict(kept)[d].split("\n")
            at = sum(len(x.split()) for x in lines[:n])
            gone.setdefault(d, set()).update(range(at, at + len(lines[n].split())))
    words = {(i, *(w for k, w in enumerate(t.split()) if k not in gone.get(i, ()))) for i, t in kept}
    assert {(i, *t.split()) for i, t in texts} == {x for x in words if len(x) > 1} and cut.schema == docs.schema
    assert all(x in texts for x in kept if x[0] not in gone)

    left = sorted(x for x in texts if x[1].strip())
    clean = stage["decontamination"](spark, table(spark, left), sf)
    leaks = {d for d, *_ in test_decontaminate.brute(left, [(1, item)])}
    assert len(leaks) == 1 and known(clean) == {x for x in left if x[0] not in leaks}

    ids = stage["token_ids"](spark, table(spark, [*left, (901, None)]), sf).collect()
    assert all(r.decodes for r in ids) and len(ids) == len(left) + 1
    for r in ids:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == other.encode_ordinary(dict(left).get(r.doc_id) or "")

    whole = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert {i for i, _ in left} - leaks <= whole


def test_stages_follow_each_other():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_paragraphs", "decontamination", "token_ids"]
    assert tiktoken and public_tokenizers and VOCABULARY


def test_rows_without_doc_id_pass(spark, prose, edited, tmp_path):
    rows, junk, item, labels = corpus(prose, edited)
    clean, clean2 = prose(123456, 90), rows[3][1]
    table(spark, [*rows, *junk, (None, clean), (None, clean2), (None, junk[25][1])]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert sorted(r.text for r in docs.collect() if r.doc_id is None) == sorted([clean, clean2]), name
    assert sum(r.doc_id is None for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == 2
