import glob
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from brindle.llm import tokenfiles
from brindle.llm.queries import VOCABULARY, op2_token_files

S = tokenfiles.Settings(VOCABULARY, public_tokenizers.PATTERN, length=16, shard_bytes=32 * 40)


def test_round_trip(documents, prose, tmp_path):
    rows = [(i, prose(i, 7 * i)) for i in range(15)] + [(90, ""), (91, None), (None, "no key"), (3, prose(3, 21)), (92, "é" * 2000)]
    folder = f"file://{tmp_path}/shards"
    index = tokenfiles.write(documents(rows), folder, S).collect()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    shards = {k: tokenfiles.read(folder, k) for k in {r.shard for r in index}}
    assert sum(map(len, shards.values())) == len(index)
    encoding = tokenfiles._encoding(S)
    want = sorted(encoding.encode_ordinary(t or "") + [S.end_id] for _, t in rows)
    texts = {}
    for r in sorted(index, key=lambda r: r.sequence):
        record = shards[r.shard][r.record]
        assert zlib.crc32(record.tobytes()) == r.record_crc32
        assert (record[r.n_tokens :] == S.end_id).all()
        texts.setdefault((r.doc_id, r.sequence) if r.doc_id == 3 else r.doc_id, []).extend(record[: r.n_tokens].tolist())
    assert sum(map(len, texts.values())) == sum(map(len, want))
    assert texts[92] == encoding.encode_ordinary("é" * 2000) + [S.end_id]
    assert (tokenfiles.read(folder, 1, 2, 3) == shards[1][2:5]).all()


def test_resumes_and_repeats(documents, prose, tmp_path):
    rows = documents([(i, prose(i, 30)) for i in range(20)])
    folder = f"file://{tmp_path}/s"
    first = sorted(map(tuple, tokenfiles.write(rows, folder, S).collect()), key=str)
    path = f"{tmp_path}/s/{tokenfiles.shard_name(0)}"
    before, other = os.stat(path).st_ino, f"{tmp_path}/s/{tokenfiles.shard_name(1)}"
    with open(other, "ab") as f:
        f.write(b"damage")
    assert sorted(map(tuple, tokenfiles.write(rows, folder, S).collect()), key=str) == first
    assert os.stat(path).st_ino == before
    assert os.path.getsize(other) % S.stride == 0
    assert not [f for f in os.listdir(f"{tmp_path}/s") if f.startswith(".shard") and not f.endswith(".crc")]


def brute_feistel(number, rows, seed):
    """The place of a number by a plain Feistel network, walked until it is below rows; xxhash64 is Spark's."""
    bits = max(2, (rows - 1).bit_length())
    low = bits // 2

    def spark_hash(*values):
        h = 42
        for v, wide in zip(values, (8, 8, 4)):
            h = xxhash.xxh64_intdigest(v.to_bytes(wide, "little"), seed=h)
        return h

    while True:
        left, right = number >> low, number & ((1 << low) - 1)
        for k in range(4):
            if k % 2 == 0:
                left ^= spark_hash(right, seed, k) & ((1 << (bits - low)) - 1)
            else:
                right ^= spark_hash(left, seed, k) & ((1 << low) - 1)
        number = left << low | right
        if number < rows:
            return number


def test_order_and_places(spark, documents, prose, tmp_path):
    rows = [(i, prose(i, 5 * (i % 17))) for i in range(120)]
    documents(rows, clash=False).repartition(3).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/in")
    key = "spark.sql.files.maxPartitionBytes"
    was, made = spark.conf.get(key), []
    for k, size in enumerate(("128m", "2k", "700")):
        spark.conf.set(key, size)
        try:
            df = spark.read.parquet(f"{tmp_path}/in")
            index = tokenfiles.write(df, f"file://{tmp_path}/out{k}", S).collect()
        finally:
            spark.conf.set(key, was)
        files = sorted(glob.glob(f"{tmp_path}/out{k}/shard-*"))
        made.append((sorted(map(tuple, index)), [(os.path.basename(f), open(f, "rb").read()) for f in files]))
    assert made[0] == made[1] == made[2] and len(made[0][1]) > 4
    # number, slot, shard and record of each sequence by hand
    order = [r.doc_id for f in sorted(glob.glob(f"{tmp_path}/in/*.parquet")) for r in spark.read.parquet(f).coalesce(1).collect()]
    size = {d: len(tokenfiles.sequences(t, S)) for d, t in rows}
    total, number = sum(size.values()), {}
    for d in order:
        for k in range(size[d]):
            number[d, k] = len(number)
    for r in index:
        slot = brute_feistel(number[r.doc_id, r.sequence], total, S.seed)
        assert (r.slot, r.shard, r.record) == (slot, slot // S.per_shard, slot % S.per_shard)


def test_second_run_reads_what_is_there(spark, documents, prose, tmp_path):
    documents([(i, prose(i, 30)) for i in range(20)], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    first = op2_token_files(spark, str(tmp_path))
    folder = first.inputFiles()[0].rsplit("/index/", 1)[0].removeprefix("file://")
    was = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/*")}
    assert sorted(map(tuple, op2_token_files(spark, str(tmp_path)).collect())) == sorted(map(tuple, first.collect()))
    assert was == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/*")} and len(was) > 3


def test_changed_texts_are_noticed(spark, documents, prose, tmp_path):
    documents([(1, "one two")], clash=False).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    planned = tokenfiles.plan(df, S)
    changed = (planned[0].withColumn("_text", F.lit("two one")), *planned[1:])
    with pytest.raises(Exception, match="has changed"):
        tokenfiles.write(df, f"file://{tmp_path}/o", S, planned=changed)


def test_empty(documents, tmp_path):
    assert tokenfiles.write(documents([]), f"file://{tmp_path}/e", S).collect() == []


def test_vocabulary_must_fit():
    with pytest.raises(ValueError):
        tokenfiles._encoding(tokenfiles.Settings(VOCABULARY, public_tokenizers.PATTERN, end_id=5))


ODD = ["", "a", " ", "  ", "a  b", "a \n b\t\tc ", "one two ", "one two  ", "it's  'll x's", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b", "\x1c\x1d a\x85\xa0b", "日本語　 テキスト", "\n\n  x", "é́ " * 300, "word " * 700 + " end", None]


def library():
    """The library's encoding by the pattern as it is, without special tokens."""
    ranks = tokenfiles._encoding(S)._mergeable_ranks
    return tiktoken.Encoding("library", pat_str=S.pattern, mergeable_ranks=ranks, special_tokens={})


def test_plain_texts_have_the_same_ids(documents, tmp_path):
    encode = library().encode_ordinary
    every = [a + c + b for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) for a, b in (("a", "b"), ("a" + c, "b"), ("a ", "b"))]
    rng = random.Random(4)
    mixed = ["".join(rng.choices([" ", " ", "\n", "\t", "\x85", "\xa0", "\u2003", "\x1c", "a", "'s", "é", "1", "!", "<|endoftext|>"], k=rng.randrange(30))) for _ in range(5000)]
    texts = pa.array([*every, *mixed, *ODD])
    assert 0 < sum(tokenfiles._plain(texts)) < len(texts)
    for text, made in zip(texts.to_pylist(), tokenfiles.column_sequences(texts, S)):
        ids = encode(text or "")
        assert made.reshape(-1).tolist() == ids + [S.end_id] * (made.size - len(ids)) and len(made) == len(ids) // S.length + 1, repr(text)
    folder = f"file://{tmp_path}/odd"
    index = tokenfiles.write(documents(list(enumerate(ODD))), folder, S).collect()
    got = {i: [] for i in range(len(ODD))}
    for r in sorted(index, key=lambda r: r.sequence):
        got[r.doc_id] += tokenfiles.read(folder, r.shard, r.record, 1)[0, : r.n_tokens].tolist()
    assert got == {i: [*encode(t or ""), S.end_id] for i, t in enumerate(ODD)}


def test_another_pattern_is_left_alone():
    for pattern in (r"\S+|\s", r"\w\|\s+(?!\S)|\s+"):
        s = tokenfiles.Settings(VOCABULARY, pattern)
        assert tokenfiles._encoding(s, True) is tokenfiles._encoding(s)


def test_cost_of_encoding(prose):
    texts = pa.array([prose(i, 400) for i in range(300)])
    encode = library().encode_ordinary

    def by_library():
        for x in texts:
            ids = encode(x.as_py())
            np.full(len(ids), S.end_id, S.kind)[:] = ids

    def cost(f):
        def once():
            begin = time.process_time()
            f()
            return time.process_time() - begin

        return min(once() for _ in range(7))

    # a pattern that looks ahead, a search for special tokens at every character or lists of ids would take all of that time
    assert cost(lambda: tokenfiles.column_sequences(texts, S)) < 0.8 * cost(by_library)
