"""Exact duplicates by distributed MSD radix partitioning.

A document's key is its length followed by the bytes of its normalised text. Each
round splits every open group by its documents' next bytes (a digit, cut at characters),
with one aggregation whose partial step runs before the shuffle. Groups of one leave; groups
whose bytes have all been compared are classes of equal texts; the rest go on. Digits
widen from round to round, so few rounds reach the end of long texts, and only the
bytes of the round travel, never whole rows. Equality is decided by bytes alone.

Between rounds a document is a label (doc_id, row hash, length); the hash only tells
rows of one doc_id apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

FIRST_DIGIT = 48
GROWTH = 64


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _split(rows: DataFrame, by: list[str]) -> DataFrame:
    """Splits groups by the columns ``by``: label, group and number of the rows that aren't alone."""
    rows = cut(rows)
    groups = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumn("__next", F.monotonically_increasing_id()))
    return (
        rows.join(groups, by)
        .groupBy("__id", "__row", "__len", "__next")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumnRenamed("__next", "__group")
    )


def equal_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """Classes of two rows or more: labels (``__id``, ``__row``, ``__len``) with ``keep_id`` and ``group_size``."""
    base = labelled(docs, doc_id, text)
    start, width = 0, first
    open_rows = cut(_split(base.select("__id", "__row", "__len", digit(base, 0, width).alias("__digit")), ["__len", "__digit"]))
    done, rounds = None, 0
    while True:
        start += width
        width = start * (growth - 1)
        ended = open_rows.where(F.col("__len") <= start).withColumn("__round", F.lit(rounds))
        rounds += 1
        done = ended if done is None else done.unionByName(ended)
        going = open_rows.where(F.col("__len") > start)
        if going.isEmpty():
            break
        to = going.select(F.col("__id").alias("__i2"), F.col("__row").alias("__r2"), F.col("__len").alias("__l2"), "__group")
        digits = base.where(F.col("__len") > start).select("__id", "__row", "__len", digit(base, start, width).alias("__digit"))
        match = F.col("__id").eqNullSafe(F.col("__i2")) & (F.col("__row") == F.col("__r2")) & (F.col("__len") == F.col("__l2"))
        rows = digits.join(to, match).select("__id", "__row", "__len", "__digit", "__group")
        open_rows = cut(_split(rows.withColumnRenamed("__group", "__from"), ["__from", "__digit"]))
    # Group numbers are unique within a round only.
    keys = ["__round", "__group"]
    sizes = done.groupBy(*keys).agg(F.max("__id").alias("keep_id"), F.sum("__rows").alias("group_size"))
    return done.join(sizes, keys).select("__id", "__row", "__len", "keep_id", "group_size")


def labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[doc_id].cast("long").alias("__id"), F.xxhash64(whole).alias("__row"), F.length(whole).alias("__len"), whole.alias("__text"))


def digit(base: DataFrame, start: int, width: int) -> Column:
    """The normalised characters start .. start + width; normalising keeps their number."""
    return normalised(F.substring(base["__text"], start + 1, width))


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the largest doc_id stays (a null doc_id is below all others). Rows that repeat a
    doc_id with equal texts are the same document: each is returned, with the same result.
    """
    classes = equal_classes(docs, doc_id, text).select(
        F.col("__id").alias("__i2"), F.col("__row").alias("__r2"), F.col("__len").alias("__l2"), "keep_id", "group_size"
    )
    base = labelled(docs, doc_id, text).select("__id", "__row", "__len", F.sha2(normalised(F.col("__text")).cast("binary"), 256).alias("text_sha256"))
    match = F.col("__id").eqNullSafe(F.col("__i2")) & (F.col("__row") == F.col("__r2")) & (F.col("__len") == F.col("__l2"))
    grouped = F.col("group_size").isNotNull()
    return base.join(classes, match, "left").select(
        F.col("__id").alias("doc_id"),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("__id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("__id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the equal documents stays, for every row of ``documents``."""
    return mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
