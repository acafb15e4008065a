"""Approximate nearest neighbours: hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample. Leaves that hold too many rows then grow trees of
their own, each fitted by a task on a bounded sample of the leaf's rows, so leaves stay small
as the table grows. Every row is dealt to a leaf. A search walks the tree with a priority
queue of nodes by the distance of their centres and collects leaves. How many leaves a
search visits is calibrated: visits are widened until the true neighbours, among all rows, of
some rows that the first tree wasn't fitted on are found at the recall asked for.

Rows are grouped by leaf into blocks of bounded size (a leaf of many equal vectors spans
several blocks), queries go to the blocks of their leaves, and each pair of blocks is
searched exactly, in double precision. No block depends on the size of a leaf.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows that the tree is fitted on, at most, chosen by hash.
SAMPLE = 20_000
#: Children of a node, and sample rows in a leaf, about.
BRANCH, LEAF = 12, 48
#: Recall that the leaf visits are calibrated to on PROBES held-out sample rows. Above the 0.9 asked for, for safety.
RECALL, PROBES = 0.97, 300
#: Rows of a block, and queries searched against it together, about.
BLOCK, QUERIES = 20_000, 20_000
#: Leaves of more rows than GROW get a tree, fitted on at most PART of the rows. With SAMPLE, LEAF and PART a tree has some 70,000 leaves at most.
GROW, PART = 20_000, 8_000


class Tree:
    """centres: a row for each node; children: node numbers, none for a leaf; leaf: a leaf's number, -1 for inner nodes."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.leaves = [sample.mean(axis=0)], [[]], [-1], 0
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            parts = self._kmeans(sample[rows], rng) if len(rows) > LEAF else None
            if parts is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            centres, label = parts
            for k in range(len(centres)):
                self.children[node].append(len(self.centres))
                self.centres.append(centres[k])
                self.children.append([])
                self.leaf.append(-1)
                todo.append((len(self.centres) - 1, rows[label == k]))
        self.centres = np.asarray(self.centres)

    @staticmethod
    def _kmeans(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
        """Non-empty clusters; None if all rows are equal."""
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2:
            return None
        centres = distinct[rng.choice(len(distinct), min(BRANCH, len(distinct)), replace=False)]
        for _ in range(12):
            label = nearest(x, centres)
            used = np.unique(label)
            moved = np.stack([x[label == k].mean(axis=0) for k in used])
            if len(moved) == len(centres) and np.allclose(moved, centres):
                break
            centres = moved
        label = nearest(x, centres)
        used = np.unique(label)
        return (centres[used], np.searchsorted(used, label)) if len(used) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by greedy descent."""
        at = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                at[rows] = self.leaf[node]
                continue
            label = nearest(x[rows], self.centres[self.children[node]])
            todo.extend((c, rows[label == k]) for k, c in enumerate(self.children[node]) if (label == k).any())
        return at

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            elif kids := self.children[node]:
                for d, c in zip(((self.centres[kids] - q) ** 2).sum(axis=1).tolist(), kids, strict=True):
                    heapq.heappush(queue, (d, c))

    def graft(self, grown: dict[int, Tree]) -> None:
        """Puts trees in the place of leaves. Their leaves take new numbers, those replaced stay unused."""
        node_of = {leaf: n for n, leaf in enumerate(self.leaf) if leaf in grown}
        centres = [self.centres]
        for leaf, sub in grown.items():
            base, node = len(self.leaf) - 1, node_of[leaf]  # the root of ``sub`` is the node that is there
            move = lambda kids, base=base: [base + c for c in kids]
            self.leaf[node], self.children[node] = -1, move(sub.children[0])
            self.leaf += [x if x < 0 else self.leaves + x for x in sub.leaf[1:]]
            self.children += [move(kids) for kids in sub.children[1:]]
            centres.append(sub.centres[1:])
            self.leaves += sub.leaves
        self.centres = np.concatenate(centres)

    def ranks(self, q: np.ndarray, leaves: list[int]) -> list[int]:
        """How many leaves a search for ``q`` visits before each of ``leaves``."""
        left, found = set(leaves), {}
        for rank, leaf in enumerate(self.best_bins(q)):
            if leaf in left:
                found[leaf] = rank
                left.discard(leaf)
            if not left:
                break
        return [found[leaf] for leaf in leaves]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks], type=column.type.value_type)
    return flat.to_numpy().astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding array<double>) without null ids and without vectors that are null, empty, zero or not finite throughout."""
    e = vectors[embedding].cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(vectors[vec_id].cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda x: x != 0)
    )


def leaf_trees(dealt: DataFrame, big: list[int]) -> dict[int, Tree]:
    """A tree for each of the leaves ``big``, fitted by a task on PART of its rows, chosen by hash."""
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("vec_id"), "vec_id"))
    own = dealt.where(F.col("leaf").isin(big)).withColumn("__r", rank).where(F.col("__r") <= PART)

    def fit(group: pa.Table) -> pa.Table:
        tree = Tree(matrix(group["embedding"]))
        return pa.table({"leaf": group["leaf"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return {r["leaf"]: pickle.loads(bytes(r["tree"])) for r in own.groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect()}


def true_leaves(dealt: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> dict[int, list[int]]:
    """By probe, the leaves of its k nearest rows of other ids among all rows. A task keeps k ids for each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple[float, int]]] = [{} for _ in probes]
        bound = np.full(len(probes), np.inf)
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            vec, leaf, x = t["vec_id"].to_numpy(), t["leaf"].to_numpy(), matrix(t["embedding"])
            apart = (x**2).sum(axis=1) - 2 * probes @ x.T + (probes**2).sum(axis=1)[:, None]
            for i, d in enumerate(apart):
                d[vec == ids[i]] = np.inf
                near = np.argpartition(d, min(4 * k, len(d) - 1))[: 4 * k + 1]
                for j in near[d[near] < bound[i]].tolist():
                    if d[j] < best[i].get(int(vec[j]), (np.inf, 0))[0]:
                        best[i][int(vec[j])] = (float(d[j]), int(leaf[j]))
                if len(best[i]) > k:
                    best[i] = dict(sorted(best[i].items(), key=lambda e: (e[1][0], e[0]))[:k])
                    bound[i] = max(v[0] for v in best[i].values())
        rows = [(i, v, *e) for i, own in enumerate(best) for v, e in own.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = [pa.int32(), pa.int64(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["probe", "vec_id", "d", "leaf"])

    found = dealt.mapInArrow(run, "probe int, vec_id long, d double, leaf int").groupBy("probe", "vec_id").agg(F.min(F.struct("d", "leaf")).alias("e"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("e.d", "vec_id"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("r", rank).where(F.col("r") <= k).select("probe", "e.leaf").collect():  # PROBES x k rows
        out.setdefault(r["probe"], []).append(r["leaf"])
    return out


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest found to each row of which ``is_query`` (Column -> Column of the id) holds: query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. A row's own id is no candidate.
    Vectors of another length than the sample's commonest take no part. Rows that repeat a vec_id count as one candidate,
    by their nearest copy. With fewer candidates than k, all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    order = [F.xxhash64("vec_id"), F.col("vec_id")]
    ids = rows.select("vec_id").distinct().orderBy(*order).limit(SAMPLE)
    # One copy of each id, so that copies are no neighbours of one another.
    sample = rows.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(*order).toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    lengths = sample["embedding"].map(len)
    dim = int(lengths.mode()[0])
    sample = sample[lengths == dim]
    x, sample_ids = np.stack(sample["embedding"].tolist()), sample["vec_id"].to_numpy()
    held = np.zeros(len(x), dtype=bool)
    held[:: max(2, len(x) // PROBES)] = len(x) > LEAF  # a smaller sample is one leaf
    tree = Tree(x[~held])
    rows = rows.where(F.size("embedding") == dim)

    def deal() -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """The rows with their leaf, and by leaf how many rows and distinct ids it has."""
        given = spark.sparkContext.broadcast(tree)

        def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                leaf = given.value.assign(matrix(t["embedding"])) if len(t) else np.zeros(0, dtype=np.int64)
                yield from t.append_column("leaf", pa.array(leaf.astype(np.int32))).to_batches()

        out = cut(rows.mapInArrow(to_leaves, "vec_id long, embedding array<double>, leaf int"))
        count, apart = np.zeros(tree.leaves, dtype=np.int64), np.zeros(tree.leaves, dtype=np.int64)
        for r in out.groupBy("leaf", "vec_id").count().groupBy("leaf").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("ids")).collect():  # a row for each leaf
            count[r["leaf"]], apart[r["leaf"]] = r["rows"], r["ids"]
        return out, count, apart

    dealt, count, apart = deal()
    if big := np.flatnonzero(count > GROW).tolist():
        grown = {leaf: t for leaf, t in leaf_trees(dealt, big).items() if t.leaves > 1}
        tree.graft(grown)
        if grown:
            dealt, count, apart = deal()
    probes = np.flatnonzero(held)
    wanted = true_leaves(dealt, sample_ids[probes], x[probes], k) if len(probes) else {}
    ranks = np.asarray([r for i, leaves in wanted.items() for r in tree.ranks(x[probes[i]], leaves)])
    visits = 1
    while len(ranks) and visits < tree.leaves and np.mean(ranks < visits) < RECALL:
        visits += max(1, visits // 8)
    shared = spark.sparkContext.broadcast(tree)  # at most some 70,000 leaves
    # Leaves in tree order fill blocks; a leaf beyond BLOCK spans several.
    first, blocks = np.zeros(tree.leaves, dtype=np.int64), np.ones(tree.leaves, dtype=np.int64)
    at = filled = 0
    for leaf, n in enumerate(count.tolist()):
        if filled and filled + n > BLOCK:
            at, filled = at + 1, 0
        first[leaf] = at
        if n > BLOCK:
            blocks[leaf] = -(-n // BLOCK)
            at += int(blocks[leaf])
        else:
            filled += n
    enough = 4 * k

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            q = pa.Table.from_batches([b])
            ids, vecs = q["vec_id"].to_numpy(), matrix(q["embedding"])
            out: dict[str, list] = {"query_id": [], "q": [], "block": [], "leaves": []}
            for i, v in zip(ids.tolist(), vecs, strict=True):
                found, seen, ids_seen = {}, 0, 0
                for leaf in t.best_bins(v):
                    if seen >= visits and ids_seen > enough:
                        break
                    seen, ids_seen = seen + 1, ids_seen + int(apart[leaf])
                    if count[leaf]:
                        for block in range(int(first[leaf]), int(first[leaf] + blocks[leaf])):
                            found.setdefault(block, []).append(leaf)
                for block, leaves in found.items():
                    for name, value in zip(out, (i, v, block, sorted(leaves)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("block", pa.int64()), ("leaves", pa.list_(pa.int32()))]))

    asked = cut(dealt.where(is_query(F.col("vec_id"))).select("vec_id", "embedding").mapInArrow(to_blocks, "query_id long, q array<double>, block long, leaves array<int>"))
    # A block that very many queries ask for meets them in parts; only such blocks are copied.
    hot = asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > QUERIES).select("block", (F.col("n") / QUERIES).cast("long").alias("__last"))
    last = F.coalesce("__last", F.lit(0).cast("long"))
    queries = asked.join(hot, "block", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), last + 1)).drop("__last")
    where = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(tree.leaves, dtype=np.int32), "__first": first, "__blocks": blocks}), "leaf int, __first long, __blocks long")
    placed = dealt.join(F.broadcast(where), "leaf").select(
        "vec_id", "embedding", "leaf", (F.col("__first") + F.pmod(F.xxhash64("vec_id"), "__blocks")).alias("block")
    ).join(hot, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__last")

    def in_block(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, leaf, vecs = right["vec_id"].to_numpy(), right["leaf"].to_numpy(), matrix(right["embedding"])
            repeats = len(np.unique(ids)) < len(ids)
            for i, q, leaves in zip(left["query_id"].to_pylist(), matrix(left["q"]), left["leaves"].to_pylist(), strict=True):
                rows = np.flatnonzero(np.isin(leaf, leaves) & (ids != i))
                d = np.sqrt(((vecs[rows] - q) ** 2).sum(axis=1))
                if repeats:  # the nearest copy of each vec_id, before the k nearest are cut
                    own = np.lexsort((d, ids[rows]))
                    own = own[np.r_[True, np.diff(ids[rows][own]) != 0]] if len(own) else own
                    rows, d = rows[own], d[own]
                if len(rows) > k:
                    rows, d = rows[d <= (most := np.partition(d, k - 1)[k - 1])], d[d <= most]
                best = np.lexsort((ids[rows], d))[:k]
                out["query_id"] += [i] * len(best)
                out["vec_id"] += ids[rows][best].tolist()
                out["score"] += d[best].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    near = queries.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInArrow(in_block, "query_id long, vec_id long, score double")
    best = (
        near.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .groupBy("query_id")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))  # at most k from each block
    )
    return best.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each embedding whose id is divisible by 100, among all others."""
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
