"""Benchmark items inside documents, by size-partitioned MinHash containment. Built-in functions only.

A text's words are its runs of letters and digits, lower-cased; its shingles are runs of
five words (a text of fewer words has its whole run as the only one). Items are
partitioned by size. An item of n shingles must have 80 percent of them in a document; so
among any floor(n / 5) + 1 of its shingles one is there. The item is posted under so many
MinHash minima (its smallest shingle hashes), so none can be missed. Documents are searched shingle by shingle for these minima, but only for items
of size classes that they are long enough to contain, and hits are verified by exact
containment of the item's whole shingle set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import BROADCAST_ROWS, Scratch, fresh, semi_join


@dataclass(frozen=True)
class Settings:
    """percent of an item's shingles that a document must hold."""

    width: int = 5
    percent: int = 80


def words(text: Column) -> Column:
    """Hashes of a text's words."""
    found = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words_column: str, width: int) -> Column:
    """Hashes of all runs of width words; with fewer words there are none."""
    run = ", ".join(f"{words_column}[i + {j}]" for j in range(width))
    return F.expr(f"case when size({words_column}) >= {width} then transform(sequence(0, size({words_column}) - {width}), i -> xxhash64({width}, {run})) else cast(array() as array<bigint>) end")


def of_widths(words_column: str, widths: list[int]) -> Column:
    return F.concat(*(shingles(words_column, w) for w in widths))


def contaminated(df: DataFrame, items: DataFrame, s: Settings = Settings(), scratch: Scratch | None = None, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, hits long, containment double) of each document that holds an item.

    Null keys and null or wordless texts take no part, on either side. Rows that repeat a
    document's key or an item's key are judged by themselves, and their pair is given once,
    with the most hits. Other columns are ignored. Empty tables give no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "leaks")
    source = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    split_items = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), words(F.col(item_text)).alias("w"))
    sized = split_items.where("size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(s.width)))
    own = F.lit(None)
    for w in range(1, s.width + 1):
        own = F.when(F.col("width") == w, F.array_distinct(shingles("w", w))).otherwise(own)
    sets = sized.withColumn("set", own).withColumn("n", F.size("set").cast("long")).select("item_id", "width", "n", "set", F.floor(F.log2("n")).cast("int").alias("size_class"))
    sets = scratch.save(sets.dropDuplicates(["item_id", "n", "set"]), "items")
    widths = sorted(r.width for r in sets.select("width").distinct().collect())  # s.width numbers at most
    if not widths:
        return sets.select(F.lit(None).cast(df.schema[key].dataType).alias("doc_id"), "item_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("containment"))
    many = F.expr(f"n - cast(ceil({s.percent} * n / 100) as long) + 1")
    minima = sets.select("item_id", "n", "size_class", F.explode(F.slice(F.array_sort("set"), F.lit(1), many.cast("int"))).alias("h"))
    # smallest size of a class: a document must have so many shingles to hold an item of it
    minima = scratch.save(minima.withColumn("least", F.expr(f"cast(ceil({s.percent} * shiftleft(1L, size_class) / 100) as long)")).select("h", "item_id", "least").distinct(), "minima")
    few = minima.count() <= BROADCAST_ROWS
    docs = source.select("doc_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    posted = docs.select("doc_id", F.size("w").alias("m"), F.explode(of_widths("w", widths)).alias("h"))
    hit = posted.join(F.broadcast(minima) if few else minima.hint("merge"), "h").where("m >= least")
    pairs = scratch.save(hit.groupBy("doc_id", "item_id").agg(F.count("*").alias("c")).select("doc_id", "item_id"), "pairs")
    needed = scratch.save(pairs.select("doc_id").distinct(), "needed")
    texts = semi_join(source, needed, "doc_id").select("doc_id", words(F.col("text")).alias("w"))
    whole = scratch.save(texts.select("doc_id", F.array_distinct(of_widths("w", widths)).alias("have")), "texts")
    both = pairs.join(whole, "doc_id").join(sets, "item_id").withColumn("hits", F.size(F.array_intersect("set", "have")).cast("long"))
    best = both.where(f"100 * hits >= {s.percent} * n").groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("hits") / F.col("n")).alias("containment"), "hits", "n")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_shingles"), F.col("b.hits").alias("hits"), F.col("b.containment").alias("containment"))


def clean(df: DataFrame, items: DataFrame, s: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """The rows of df (doc_id, text) whose text holds no item.

    Rows without doc_id or text, and empty texts, stay. Rows that repeat a doc_id are judged
    one by one, each by its own text. Empty tables are fine on either side.
    """
    scratch = scratch or Scratch(df.sparkSession, "leaks")
    doc, t = (fresh(df, x) for x in ("_doc", "_t"))
    own = F.xxhash64(F.col("text").cast("string"))
    rows = df.where(F.col("doc_id").isNotNull()).select(F.struct(F.col("doc_id").alias("doc"), own.alias("t")).alias("doc_id"), "text")
    found = scratch.save(contaminated(rows, items, s, scratch).select(F.col("doc_id.doc").alias(doc), F.col("doc_id.t").alias(t)).distinct(), "found")
    return df.join(found, (F.col("doc_id") == F.col(doc)) & (own == F.col(t)), "left_anti").select(*df.columns)
