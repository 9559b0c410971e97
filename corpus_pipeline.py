"""From raw documents to token ids: quality filter, near-duplicates, repeated paragraphs, benchmark leaks, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before has
kept, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, near_dedup, quality, substring
from brindle.llm.queries import VOCABULARY
from brindle.llm.util import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted on the labelled ones, scores under one half."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component, that of the smallest doc_id (5-word shingles, 80 percent)."""
    return near_dedup.without_duplicates(docs)


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines of 20 words and passages of 50 words or more that repeat from all documents but the first; documents that lose everything go.

    Rows without doc_id or text, and empty texts, stay as they are.
    """
    return substring.without_repeats(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 80 percent of a benchmark item; rows without doc_id or text, and empty ones, stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decodes): byte-level BPE ids of each text, and that they decode to its bytes; a null text is empty, rows that repeat are each encoded."""
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, keep=("text",), check=True)
    return encoded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("decodes"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_paragraphs", repeated_paragraphs),
    ("decontamination", no_benchmark),
    ("token_ids", token_ids),
]
#: SQL can't express a fitted classifier or BPE; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
