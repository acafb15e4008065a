import hashlib
import math
import random

import pytest

from askalot.llm import centroids

NAN, INF = float("nan"), float("inf")


def plain(rows, dimensions, k, rounds, seed=3):
    """Whole distances each round, in Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cs = [list(q) for i, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cs)):
            own = [q for (_, q), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    inertia = [sum(d for d, c in at if c == j) for j in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True)), key=repr)


def got(points, **how):
    rows = centroids.with_inertia(*centroids.cluster(points, **how))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_equal_to_whole_distances(spark, rounds):
    deal = random.Random(5)
    rows = [(n, [deal.gauss(n % 3, 0.6) * (-1) ** j for j in range(6)]) for n in range(90)]
    rows += [(200, [1.0] * 6)] * 4 + [(None, [0.5] * 6)] * 2 + [(201, [0.25, -0.25] * 3), (202, [0.25, -0.25] * 3)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [1.0, None] * 3), (305, [NAN] * 6), (306, [INF, 1.0, 1.0, 1.0, 1.0, 1.0]), (307, [0.0] * 6)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, q string")
    want = plain(rows, 6, 4, rounds)
    assert got(centroids.quantised(table, 6), k=4, rounds=rounds) == want and len(want) == 99


def test_ends_early_and_few_vectors(spark):
    rows = [(n, [float(n // 5), 0.0]) for n in range(10)]
    points = centroids.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2)
    assert got(points, k=2, rounds=30) == plain(rows, 2, 2, 30)
    assert got(points.limit(3), k=8, rounds=3) == plain(rows[:3], 2, 8, 3)
    state, cs = centroids.cluster(points.limit(0))
    assert centroids.with_inertia(state, cs).count() == 0 and len(cs) == 0
    assert centroids.with_inertia(state, cs).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_only_changed_components_are_multiplied(spark):
    points = spark.createDataFrame([(1, [1, 2, 3]), (2, [-4, 5, -6])], "vec_id long, q array<long>")
    first, second = centroids.np.array([[1, 1, 1], [0, 0, 9]]), centroids.np.array([[1, 7, 1], [0, 0, 9]])
    state = centroids.moved(centroids.moved(points, None, first), first, second)
    assert {r["vec_id"]: (r["dots"], r["cluster"], r["distance"]) for r in state.collect()} == {1: ([18, 27], 0, 29), 2: ([25, -54], 0, 78)}


def test_components_too_large_are_an_error(spark):
    far = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds"):
        centroids.quantised(far, 2).collect()
