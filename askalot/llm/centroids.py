"""Centroid clustering over an incremental distance matrix, in exact integers.

Each vector keeps its dot product with every centroid. When centroids move, a dot product changes by the
moved components alone: only those whose integer value differs from the last round's are multiplied. The squared distance is then
|v|^2 - 2 v.c + |c|^2, and the nearest centroid is the argmin of the row. Vectors and products are
written to the shared folder each round, so a lost executor repeats a round's part and not the rounds before.
What travels to the tasks is the changes of the centroids: at most centroids x components numbers,
whatever the number of vectors; what comes back is a count and a sum per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Integer components beyond this could overflow a product.
LARGEST = 2**27


def quantised(vectors: DataFrame, dimensions: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) of each component, for vectors of exactly ``dimensions`` components of which none is null or non-finite.

    Others are left out. A component beyond 2^27 after scaling is an error, as exact sums of products need room.
    """
    v = vectors[embedding].cast("array<double>")
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * float(scale)))
    fits = F.forall(v, lambda x: F.abs(x * float(scale)) <= float(LARGEST))
    kept = vectors.where(F.coalesce(whole, F.lit(False)))
    return kept.select(vectors[vec_id].cast("long").alias("vec_id"), F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling"))).alias("q"))


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest sha256(``seed:vec_id``) in that order (a null id is written as nothing; ties by components)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.orderBy(digest, "q").limit(k).collect()
    return np.array([r["q"] for r in rows], dtype=np.int64)


STATE = "vec_id long, q array<long>, dots array<long>, cluster int, distance long"


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _column(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def moved(points: DataFrame, before: np.ndarray | None, after: np.ndarray) -> DataFrame:
    """The state after the centroids went from ``before`` to ``after``: products updated by the components that changed, nearest centroid (ties: the smaller number) and distance anew."""
    change = after if before is None else after - before
    changes = [(k, np.flatnonzero(change[k])) for k in range(len(after))]
    changes = [(k, at, change[k, at]) for k, at in changes if len(at)]
    squares, width = (after * after).sum(axis=1), after.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _rows(batch.column(1), width)
            dots = np.zeros((len(q), len(squares)), dtype=np.int64) if before is None else _rows(batch.column(2), len(squares)).copy()
            for k, at, by in changes:
                dots[:, k] += q[:, at] @ by
            beyond = squares - 2 * dots
            nearest = beyond.argmin(axis=1)
            distance = (q * q).sum(axis=1) + beyond[np.arange(len(q)), nearest]
            yield pa.record_batch([batch.column(0), _column(q), _column(dots), pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "q", "dots", "cluster", "distance"])

    return points.mapInArrow(run, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of each cluster's mean; a centroid without vectors stays. One row a centroid comes to the driver."""
    sums = [F.sum(F.col("q")[j]).alias(f"s{j}") for j in range(centroids.shape[1])]
    after = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        after[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(centroids.shape[1])]
    return after


def cluster(points: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids) after ``rounds`` rounds of assigning and averaging and one more assignment. Once no centroid moves, the rounds left would change nothing and are spared.

    ``points`` are (vec_id, q) with vectors of one length; rows that repeat count each. Fewer vectors than ``k`` give as many
    centroids, none gives an empty state.
    """
    points = stored(points)
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.sparkSession.createDataFrame([], STATE), centroids
    state = stored(moved(points, None, centroids))
    discard(points)
    for _ in range(rounds):
        after = means(state, centroids)
        if (after == centroids).all():
            break
        last, state = state, stored(moved(state, centroids, after))
        discard(last)
        centroids = after
    return state, centroids


def with_inertia(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): the sums of squared distances of the cluster and of all, and a digest of the centroid."""
    spark = state.sparkSession
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row a centroid
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of ``embeddings`` after ten rounds."""
    return with_inertia(*cluster(quantised(table(spark, sf_dir, "embeddings"))))


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64) -> str:
    """The same by whole distances in every round. Vectors are (row number, component, value) there."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
 WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dimensions})""",
        "parts AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range(len(q))) AS j FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS k, q AS c FROM kept QUALIFY k < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, min_by(k, (d, k)) AS k, min(d) AS d FROM (
 SELECT r, k, sum((x - y) * (x - y)) AS d FROM parts JOIN (SELECT k, unnest(c) AS y, unnest(range(len(c))) AS j FROM c{n}) USING (j) GROUP BY r, k) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
 SELECT k, list(m ORDER BY j) AS m FROM (SELECT k, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
  SELECT k, j, sum(x) AS s, count(*) AS n FROM parts JOIN a{n} USING (r) GROUP BY k, j)) GROUP BY k) USING (k))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (k)"""
