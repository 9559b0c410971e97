"""The query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import hashlib
import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, near_dedup, quality, sharding, substring, tokenfiles, topk, toxicity
from .labelled import remainder
from .util import Scratch, scratch_root

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 4-word shingles at 80 percent."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.NearDuplicates(width=4))


def _judged(scores: DataFrame, divisor: int, held: int) -> DataFrame:
    return scores.select("doc_id", (remainder("doc_id", divisor) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels whose remainder by 5 isn't 0."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(documents, labels.where(remainder("doc_id", 5) != 0))
    return _judged(toxicity.score(documents, model), 5, 0)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 512 ids in shards of 32 MB in the shared folder; a row for each sequence.

    The folder is named after the input's path and contents and outlives the session; a
    second run over the same files finds its shards there.
    """
    settings = tokenfiles.Settings(VOCABULARY, public_tokenizers.PATTERN)
    documents, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "tokens")
    planned = tokenfiles.plan(documents, settings, scratch)
    name = hashlib.sha256(json.dumps([sf_dir, planned[2]], sort_keys=True).encode()).hexdigest()[:32]
    return tokenfiles.write(documents, f"{scratch_root(spark)}/brindle-shards/{name}", settings, scratch, planned=planned)


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each participant; spans as text, begin-end by commas."""
    out = chat.rotations(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["begin"], x["end"])), ",")
    return out.withColumn("train_spans", spans).drop("spans")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of all documents, and of the bytes that they decode to."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, check=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels whose remainder by 3 isn't 1."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels.where(remainder("doc_id", 3) != 1))
    return _judged(quality.score(documents, model), 3, 1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item of which it holds 80 percent."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of each vector whose id is divisible by 50, against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 16 shards by a keyed permutation of their row numbers."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of 20 words or more and every passage of 50 words or more that repeats in all documents, as spans of characters."""
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("first_doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_token_files,
        op3_toxicity,
        op4_chat_rotation,
        op5_byte_bpe,
        op6_quality,
        op7_decontamination,
        op8_exact_top_k,
        op9_sharding,
        op10_substring_dedup,
    )
}
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Distinct runs of {width} words of each row of {source} (id, text), as (id, g); with fewer words the whole sequence.
_SHINGLES = r"""
w AS (
  SELECT id, regexp_extract_all(""" + _LOWER.format("text") + r""", '[^\x20\x09-\x0D]+') AS w FROM {source}
), s AS (
  SELECT DISTINCT id, array_to_string(w[k : k + {width} - 1], ' ') AS g
  FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - {width} + 1, 1))) AS k FROM w WHERE len(w) > 0)
), n AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), links AS (
  SELECT a.id AS a, b.id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id
  GROUP BY a.id, b.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT id AS a, id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS id, min(b) AS component FROM reach GROUP BY a
)
"""
ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": "WITH RECURSIVE "
    + _SHINGLES.strip().format(source="(SELECT doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)", width=4)
    + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  coalesce(d.doc_id = coalesce(c.component, d.doc_id), false) AS kept
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN components c ON c.id = d.doc_id
""",
    "op10_substring_dedup": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM texts
), p AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY doc_id, line) AS id FROM (
    SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
  WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) >= 20
), """
    + _SHINGLES.strip().format(source="p", width=5)
    + """
, m AS (
  SELECT id, component, count(*) OVER (PARTITION BY component) AS members FROM components
), found_lines AS (
  SELECT p.doc_id, 'line' AS unit, p.before + length(p.text) - length(ltrim(p.text, {blanks})) AS "begin", p.before + length(rtrim(p.text, {blanks})) AS "end",
    len(regexp_extract_all(p.text, '[^\x20\x09-\x0D]+')) AS words, p.id <> m.component AS removed
  FROM m JOIN p USING (id) WHERE m.members > 1
), word AS MATERIALIZED (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (
    SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
    FROM (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS pieces FROM texts))
), lists AS (
  SELECT doc_id, list({lower} ORDER BY k) AS w FROM (SELECT doc_id, k, ltrim(piece, {blanks}) AS text FROM word) GROUP BY doc_id
), runs AS MATERIALIZED (
  SELECT doc_id, k, doc_id * 268435456 + k AS place, md5(array_to_string(w[k : k + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM lists WHERE len(w) >= 50)
), marked AS (
  SELECT doc_id, k, place - a >= 50 AS removed, z - a >= 50 AS again
  FROM runs JOIN (SELECT g, min(place) AS a, max(place) AS z FROM runs GROUP BY g) USING (g)
), islands AS (
  SELECT *, sum(CASE WHEN k > was + 50 OR was IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, removed ORDER BY k) AS island
  FROM (SELECT doc_id, k, removed, lag(k) OVER (PARTITION BY doc_id, removed ORDER BY k) AS was FROM marked WHERE removed OR again)
), stretches AS (
  SELECT doc_id, removed, min(k) AS first, max(k) + 49 AS last FROM islands GROUP BY doc_id, removed, island
), found AS (
  SELECT * FROM found_lines
  UNION ALL
  SELECT s.doc_id, 'passage', x.stop - length(ltrim(x.piece, {blanks})), y.stop, last - first + 1, removed
  FROM stretches s JOIN word x ON x.doc_id = s.doc_id AND x.k = first JOIN word y ON y.doc_id = s.doc_id AND y.k = last
)
SELECT doc_id, unit, CAST("begin" AS INTEGER) AS "begin", CAST("end" AS INTEGER) AS "end", CAST(words AS INTEGER) AS words, removed FROM found
""".replace("{blanks}", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)").replace("{lower}", _LOWER.format("text")),
    "op4_chat_rotation": """
WITH t AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS pos FROM t
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS DISTINCT FROM 'system'
), c AS (
  SELECT *, pos // 64 AS part, true AS own FROM n
  UNION ALL SELECT *, pos // 64 + 1, false FROM n WHERE pos % 64 >= 56
  UNION ALL SELECT n.*, x.part, false FROM n
    JOIN (SELECT DISTINCT conv_id, pos // 64 AS part FROM n WHERE pos >= 64) x USING (conv_id) WHERE n.pos = 0 AND n.role = 'system'
), s AS (
  SELECT c.conv_id, speaker, part, pos, own, text, coalesce(own AND role IS NOT DISTINCT FROM speaker, false) AS trained,
    CASE WHEN role IS NOT DISTINCT FROM speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' WHEN role IS NULL THEN '<|user|>'
         ELSE '<|user:' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' END || chr(10) AS head
  FROM c JOIN p ON p.conv_id = c.conv_id
), e AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos) AS stop FROM s
)
SELECT conv_id, speaker, CAST(part AS INTEGER) AS part, count(*) FILTER (WHERE own) AS n_turns,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text,
  coalesce(string_agg(CASE WHEN trained THEN (stop - length(text) - 8)::VARCHAR || '-' || stop::VARCHAR END, ',' ORDER BY pos), '') AS train_spans
FROM e GROUP BY conv_id, speaker, part HAVING bool_or(own)
""",
    "op7_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS width, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM i WHERE len(w) > 0)
), document_shingles AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[k : k + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS k
        FROM d, (SELECT DISTINCT width FROM item_shingles) WHERE len(w) >= width)
), sizes AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
), found AS (
  SELECT doc_id, item_id, count(*) AS hits
  FROM item_shingles JOIN document_shingles USING (width, g) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n AS n_shingles, hits, hits / n AS containment
FROM found JOIN sizes USING (item_id) WHERE 100 * hits >= 80 * n
""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
""",
}
