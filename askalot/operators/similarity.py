"""Which questions give a target away: by the nearness of their texts' vectors, and by shared words."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.binding import let

THRESHOLD = 0.7


def question_text(variables: DataFrame) -> DataFrame:
    """(code, text): the question, without one the description, without that the code. An empty text stays."""
    return variables.select("code", F.coalesce("question", "description", "code").alias("text"))


def hashed_words(texts: pd.Series, size: int = 64) -> np.ndarray:
    """Counts of words by a hash, for use where no model is at hand."""
    import zlib

    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            out[i, zlib.crc32(w.encode()) % size] += 1
    return out


def embed(texts: DataFrame, embedder: Callable[[pd.Series], np.ndarray] | None = None, text: str = "text", factory: Callable[[], Callable] | None = None) -> DataFrame:
    """Adds ``embedding`` (array<double>, replacing a column of that name): batches of texts through ``embedder``, or one that ``factory`` makes once in each task,
    such as a loaded model. Without either, ``weighted_words``."""
    if embedder is None and factory is None:
        return weighted_words(texts, text)
    rows = texts.drop("embedding")
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = factory() if factory else embedder
        for batch in batches:
            yield batch.assign(embedding=[v.tolist() for v in np.asarray(own(batch[text]), dtype=float)])

    return rows.mapInPandas(run, schema)


def weighted_words(texts: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """Adds ``embedding``: counts of a text's words (lower case, by white space) in ``size`` buckets by hash, each times ln((n + 1) / (texts with the bucket + 1)).

    Two passes over the texts: the first gives one number a bucket, whatever their number, which the second takes along as constants. A null text counts as empty.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: (F.conv(F.substr(F.md5(w), F.lit(1), F.lit(8)), 16, 10).cast("long") % size).cast("int"))
    n = texts.count()
    found = texts.select(F.explode(F.array_distinct(buckets)).alias("bucket")).groupBy("bucket").count().collect()
    with_bucket = {r["bucket"]: r["count"] for r in found}
    weights = F.array(*[F.lit(math.log((n + 1) / (with_bucket.get(k, 0) + 1))) for k in range(size)])
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(own, lambda x: x == k)) * F.get(weights, k))
    return texts.withColumn("embedding", let(buckets, counts))


def with_norm(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    e = F.col(embedding)
    return vectors.withColumn("__norm", F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Null where a vector is zero, so that it passes no threshold."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm_a * norm_b)


#: Targets whose vectors tasks take along as one matrix; more are paired by a join.
MATRIX = 4_000
#: Features that meet the matrix together.
BLOCK = 1_000


class Matrix:
    """The targets' vectors, of one length, and their norms. Targets of another length, or without a whole vector, are near nothing."""

    def __init__(self, rows: list[tuple]):
        self.keys = [k for k, _ in rows]
        self.width = Counter(len(v) for _, v in rows if v).most_common(1)[0][0] if any(v for _, v in rows) else 0
        self.vectors = self.whole([v for _, v in rows])
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))

    def whole(self, vectors: list) -> np.ndarray:
        """Vectors as rows; those that can't be compared are zero, so that they have no similarity."""
        out = np.zeros((len(vectors), self.width))
        for k, v in enumerate(vectors):
            if v is not None and len(v) == self.width and not any(x is None for x in v):
                out[k] = v
        return out

    def scores(self, vectors: list) -> np.ndarray:
        """Features by targets; NaN where a vector is zero."""
        own = self.whole(vectors)
        with np.errstate(divide="ignore", invalid="ignore"):
            return own @ self.vectors.T / np.outer(np.sqrt((own**2).sum(axis=1)), self.norms)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _sides(targets: DataFrame, features: DataFrame, key: str, embedding: str) -> tuple[Matrix | None, DataFrame]:
    """The targets as a matrix, or None if they are too many; features that are no targets."""
    few = targets.select(key, embedding).limit(MATRIX + 1).collect()
    own = features.select(key, embedding).join(targets.select(key).distinct(), key, "left_anti")
    return (Matrix([(r[0], r[1]) for r in few]) if len(few) <= MATRIX else None), own


def similarities(targets: DataFrame, features: DataFrame, key: str = "code", embedding: str = "embedding") -> DataFrame:
    """(target, feature, similarity) of every target with every feature that is no target.

    Targets are a few questions of a survey: their vectors, ``MATRIX`` at most, go to the tasks, and blocks of features are multiplied with them. More targets are paired by a
    join. Each feature meets each target, so the work is their product; for corpora, see the index over vectors in the corpus operators.
    """
    matrix, own = _sides(targets, features, key, embedding)
    if matrix is None:
        t = with_norm(targets.select(key, embedding)).select(F.col(key).alias("target"), F.col(embedding).alias("__a"), F.col("__norm").alias("__na"))
        f = with_norm(own).select(F.col(key).alias("feature"), F.col(embedding).alias("__b"), F.col("__norm").alias("__nb"))
        return f.crossJoin(t).select("target", "feature", cosine(F.col("__a"), F.col("__b"), F.col("__na"), F.col("__nb")).alias("similarity"))
    schema = StructType([StructField("target", targets.schema[key].dataType), StructField("feature", features.schema[key].dataType), StructField("similarity", DoubleType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(matrix.keys, kinds.field(0).type)
        for keys, vectors in _blocks(batches):
            scores = matrix.scores(vectors)
            at = pa.array(np.tile(np.arange(len(names)), len(keys)))
            of = pa.array(np.repeat(np.arange(len(keys)), len(names)))
            flat = scores.reshape(-1)
            yield pa.record_batch([names.take(at), pa.array(keys, kinds.field(1).type).take(of), pa.array(flat, mask=np.isnan(flat))], schema=kinds)

    return own.mapInArrow(run, schema)


def nearest_features(targets: DataFrame, features: DataFrame, k: int = 5, threshold: float = THRESHOLD, key: str = "code", embedding: str = "embedding") -> DataFrame:
    """What ``leakage_report`` gives of ``similarities``, without a table of all pairs: each task keeps the ``k`` nearest features of each target (ties: the smaller key), and these are ranked."""
    matrix, own = _sides(targets, features, key, embedding)
    if matrix is None:
        return leakage_report(similarities(targets, features, key, embedding), k, threshold)
    schema = StructType([StructField("target", targets.schema[key].dataType), StructField("feature", features.schema[key].dataType), StructField("similarity", DoubleType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in matrix.keys]
        for keys, vectors in _blocks(batches):
            scores = matrix.scores(vectors)
            for t, kept in enumerate(best):
                column = scores[:, t]
                least = kept[-1][0] if len(kept) == k else np.inf
                near = np.flatnonzero(-column <= least)  # NaN is near nothing
                if len(near) > k:
                    near = near[-column[near] <= np.partition(-column[near], k - 1)[k - 1]]
                best[t] = heapq.nsmallest(k, [*kept, *((-float(column[i]), keys[i]) for i in near)])
        rows = [(matrix.keys[t], name, -score) for t, kept in enumerate(best) for score, name in kept]
        yield pa.record_batch([pa.array([r[c] for r in rows], kinds.field(c).type) for c in range(3)], schema=kinds)

    return leakage_report(own.mapInArrow(run, schema), k, threshold)


def exclusions(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(target_code, excluded): the features at or above the threshold, as ``instances`` takes them."""
    return scores.where(F.col("similarity") >= threshold).groupBy(F.col("target").alias("target_code")).agg(F.array_sort(F.collect_list("feature")).alias("excluded"))


def exclusion_counts(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(target, n): how many features each target bars, none included."""
    return scores.groupBy("target").agg(F.count_if(F.col("similarity") >= threshold).alias("n"))


def leakage_report(scores: DataFrame, k: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(target, rank, feature, similarity, excluded): the k nearest features of each target, whether they pass the threshold or not."""
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("similarity"), "feature"))
    return scores.where("similarity is not null").withColumn("rank", rank).where(F.col("rank") <= k).withColumn("excluded", F.col("similarity") >= threshold)


def keywords(text: Column) -> Column:
    """Words longer than four characters, their marks counted in, in lower case without marks at their ends."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 4)
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, r"^[?.,!]+|[?.,!]+$", "")))


def keyword_leakage(targets: DataFrame, features: DataFrame, key: str = "code", text: str = "text", least: int = 2) -> DataFrame:
    """(target, feature, n_shared): features that share ``least`` or more keywords with a target.

    What two of them share depends on their keywords alone. So words meet in a join of the distinct lists of keywords, not of all rows, and only pairs of
    lists that share enough are written out for the rows that have them: the work is that of the result, whatever the number of words that all texts have.
    """
    def listed(rows: DataFrame, name: str) -> DataFrame:
        """(name, words): all keywords of a key's texts, with repeats, as one string; words hold no white space."""
        own = rows.select(F.col(key).alias(name), keywords(F.col(text)).alias("w")).groupBy(name).agg(F.array_sort(F.flatten(F.collect_list("w"))).alias("w"))
        return own.where(F.size("w") > 0).select(name, F.array_join("w", " ").alias(f"{name}_words"))

    own = listed(features.join(targets.select(key).distinct(), key, "left_anti"), "feature")
    given = listed(targets, "target")
    each = lambda rows, c: rows.select(c).distinct().select(c, F.explode(F.split(c, " ", -1)).alias("word"))
    shared = each(given, "target_words").join(each(own, "feature_words"), "word").groupBy("target_words", "feature_words").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= least)
    # Few rows make many pairs, so both sides are dealt to all cores, whichever is sent to the other; by size they would stand in one or two tasks.
    dealt = lambda rows: rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    return dealt(own).join(dealt(shared), "feature_words").join(given, "target_words").select("target", "feature", "n_shared")
