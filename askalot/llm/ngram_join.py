"""Documents that share most of their word n-grams: an exact Jaccard self-join and its components.

1. Every document becomes a set of hashed shingles. Equal sets are one node, named by a
   hash of the set, so exact copies cost nothing further. A frequency sketch of fixed size
   is filled from all documents on the way. Its median is what rare shingles alone put in a
   cell, so what stands out of it is a frequency, however many shingles there are.
2. A node's shingles are put in order, rare ones first. Two sets that are similar enough
   share a shingle among their first n - ceil(t n) + 1; only these are shuffled.
3. Nodes that meet in a short list are paired, in a long one linked to its first node, if
   lengths and positions allow the overlap. The suffix filter compares how many shingles of
   either set fall in each of PARTS parts. Pairs left are verified once, on whole sets.
4. In long lists, nodes that these links left in different components are then paired in
   blocks of bounded size, filtered and verified alike. Pairs within a component need no check.
   A block with many pairs first names only a spanning forest of them; its list comes again, with
   all pairs that are then still between components. So a group of thousands of near copies
   doesn't cost the square of its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, drop_stored, stored, stored_by, table
from .components import connected_components

#: Two documents link when SHARE times the intersection is at least PART times the union.
PART, SHARE = 75, 100
WORDS = 5
#: Cells of the frequency sketch, and its parts.
CELLS, CHUNKS = 1 << 20, 16
#: Prefix shingles in a bucket, about; lists of more than SHORT nodes are linked to their first node at first.
BUCKET, SHORT = 200_000, 8
#: Nodes of a list in a block; a list that the sketch expects to be longer than HOT is dealt to several buckets.
BLOCK, HOT = 4_096, 50_000
#: Partners that are verified against a node together.
TOGETHER = 256
#: Pairs for each node of a block from which a spanning forest is named first.
MANY = 4
#: Bits for each id in the Bloom filter of documents whose sets are needed, places of an id, and the most bits as a power of 2 (16 MB).
BLOOM, PROBES, MOST_BITS = 12, 4, 27
#: Parts of the suffix filter.
PARTS = 512
#: Bytes kept of a shingle for verification, and bytes of sets in a bucket of their table, about.
KEPT, BUCKET_BYTES = 7, 32 << 20
MEMO = 600_000
ENTRY = np.dtype([("token", "<u4"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4")])
ODD = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Shingler:
    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The set as sorted distinct 64-bit hashes; empty for texts without a word."""
        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(memo))
        w = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(WORDS, len(w))
        m = len(w) - size + 1
        h = np.full(m, size, dtype=np.uint64)
        for k in range(size):
            h = (h ^ (h >> np.uint64(29))) * ODD[k] + w[k : k + m]
        h = (h ^ (h >> np.uint64(32))) * ODD[0]
        return np.unique(h ^ (h >> np.uint64(29)))


def set_name(s: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """A name of 64 bits; of sets whose name is in ``clashes``, a second one."""
    name, second = set_names(s)
    return second if name in clashes else name


def set_names(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h & (1 << 64) - 1, h >> 64))


def cell(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(20)) % np.uint64(CELLS)).astype(np.int64)


def parts(s: np.ndarray) -> bytes:
    """How many shingles fall in each of PARTS parts, 255 at most, for the suffix filter."""
    n = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=PARTS)
    return zlib.compress(np.minimum(n, 255).astype("u1").tobytes(), 1)


def read_parts(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(zlib.decompress, packed)), dtype="u1").reshape(-1, PARTS).astype(np.int16)


def needed(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The smallest overlap of linked sets: SHARE o >= PART (n1 + n2 - o)."""
    return -(-PART * (n1 + n2) // (PART + SHARE))


def texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, node, second, parts), and rows of the frequency sketch (chunk, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, sketch = Shingler(), np.zeros(CELLS, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("second", pa.int64()), ("parts", pa.binary()), ("chunk", pa.int32()), ("cells", pa.binary())])
        seen = False
        for b in batches:
            n, names, own, held = [], [], [], []
            for t in b.column("text").to_pylist():
                s = sh.shingles(t)
                n.append(len(s))
                names.append(set_names(s))
                own.append(parts(s) if len(s) else b"")
                held.append(cell(s))
            if held:
                sketch += np.bincount(np.concatenate(held), minlength=CELLS)
                seen = True
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), pa.array(own, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
        if seen:
            none = [None] * CHUNKS
            cells = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in np.split(np.minimum(sketch, 2**32 - 1), CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64())] * 4 + [pa.array(none, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(cells, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, node long, second long, parts binary, chunk int, cells binary")


def sketch_of(described: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: CELLS numbers, however many documents."""

    def add(left: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // CHUNKS, dtype=np.int64)
        for c in left["cells"].to_pylist():
            total += np.frombuffer(zlib.decompress(c), dtype="<u4")
        return pa.table({"chunk": left["chunk"][:1], "cells": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    rows = described.where("chunk is not null").select("chunk", "cells").groupBy("chunk").applyInArrow(add, "chunk int, cells binary").collect()
    whole = np.zeros(CELLS, dtype="<u4")
    for r in rows:
        at = r["chunk"] * (CELLS // CHUNKS)
        whole[at : at + CELLS // CHUNKS] = np.frombuffer(bytes(r["cells"]), dtype="<u4")
    return whole


def prefixes(docs: DataFrame, sketch: np.ndarray, buckets: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(bucket, salt, entries): each set's prefix shingles, packed by bucket.

    Cells order the shingles. How long a list is, for the salts, is what its cell holds beyond the median one.
    """
    common = int(np.median(sketch))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, seen = Shingler(), set()
        for b in batches:
            held = []
            for t in b.column("text").to_pylist():
                s = sh.shingles(t)
                node = set_name(s, clashes)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                n = len(s)
                often = shared.value[cell(s)]
                order = np.lexsort((s, often))[: n - -(-PART * n // SHARE) + 1]
                e = np.zeros(len(order), dtype=[("bucket", "<i8"), ("salt", "<i4"), ("entry", ENTRY)])
                token = s[order]
                e["bucket"] = (token >> np.uint64(33)) % np.uint64(buckets)
                salts = 1 + np.maximum(0, often[order].astype(np.int64) - common) // HOT
                e["salt"] = np.where(salts > 1, 1 + node % salts, 0)  # 0 says that the list is whole
                e["entry"]["token"] = token & np.uint64(0xFFFFFFFF)
                e["entry"]["node"], e["entry"]["n"], e["entry"]["pos"] = node, n, np.arange(len(order))
                held.append(e)
            if held:
                e = np.concatenate(held)
                e = e[np.lexsort((e["salt"], e["bucket"]))]
                starts = np.flatnonzero(np.r_[True, (np.diff(e["bucket"]) != 0) | (np.diff(e["salt"]) != 0)])
                blobs = [e["entry"][x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(e)], strict=True)]
                yield pa.RecordBatch.from_pydict({"bucket": e["bucket"][starts], "salt": e["salt"][starts], "entries": blobs}, schema=pa.schema([("bucket", pa.int64()), ("salt", pa.int32()), ("entries", pa.binary())]))

    return docs.mapInArrow(run, "bucket long, salt int, entries binary")


def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length and positional filters on entries of one shingle."""
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    rest = 1 + np.minimum(nx - x["pos"] - 1, ny - y["pos"] - 1)
    return (SHARE * np.minimum(nx, ny) >= PART * np.maximum(nx, ny)) & (rest >= needed(nx, ny)) & (x["node"] != y["node"])


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("token", pa.int64())])


def pairs_table(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
    return {"a": p[:, 0], "b": p[:, 1]}


def meet(group: pa.Table) -> pa.Table:
    """Pairs (a, b) of a bucket, and the entries (a, n, pos, token) of its long lists."""
    bucket, salt = group["bucket"][0].as_py(), group["salt"][0].as_py()
    e = np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in group["entries"].to_pylist()])
    e = e[np.lexsort((e["node"], e["token"]))]
    e = e[np.r_[True, (np.diff(e["token"].astype(np.int64)) != 0) | (np.diff(e["node"]) != 0)]]
    starts = np.flatnonzero(np.r_[True, np.diff(e["token"].astype(np.int64)) != 0])
    size = np.diff(np.r_[starts, len(e)])
    run = np.repeat(np.arange(len(starts)), size)
    # A salted list goes on in other buckets, so it counts as long throughout; its salts are 1 and up.
    hot = salt > 0
    long = (size > SHORT) | hot
    a, b = [], []
    for d in range(1, 2 if hot else SHORT):
        i = np.flatnonzero((run[:-d] == run[d:]) & ~long[run[:-d]]) if len(e) > d else np.zeros(0, dtype=int)
        i = i[allowed(e[i], e[i + d])]
        a.append(e["node"][i])
        b.append(e["node"][i + d])
    i = np.flatnonzero(long[run])
    first = starts[run[i]]
    ok = allowed(e[first], e[i])
    a.append(e["node"][first[ok]])
    b.append(e["node"][i[ok]])
    p = pairs_table(np.concatenate(a), np.concatenate(b))
    none, rest = len(p["a"]), len(i)
    return pa.table(
        {
            "a": np.r_[p["a"], e["node"][i]],
            "b": pa.array(np.r_[p["b"], np.zeros(rest, dtype=np.int64)], mask=np.r_[np.zeros(none, dtype=bool), np.ones(rest, dtype=bool)]),
            "n": np.r_[np.zeros(none, dtype=np.int64), e["n"][i].astype(np.int64)],
            "pos": np.r_[np.zeros(none, dtype=np.int64), e["pos"][i].astype(np.int64)],
            "token": np.r_[np.zeros(none, dtype=np.int64), (bucket << 32) + e["token"][i].astype(np.int64)],
        }
    ).cast(PAIRS)


def suffix_filter(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose parts allow the overlap: the sum of differences bounds the sets' difference from below."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("parts").alias("p1"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("parts").alias("p2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                n1, n2 = t.column("n1").to_numpy(), t.column("n2").to_numpy()
                apart = np.abs(read_parts(t.column("p1").to_pylist()) - read_parts(t.column("p2").to_pylist())).sum(axis=1)
                keep = pa.array(apart <= n1 + n2 - 2 * needed(n1, n2))
                yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "n1", "n2", "p1", "p2").mapInArrow(run, "a long, b long")


def probes(ids: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places in a Bloom filter of that many bits for each id."""
    h = ids.astype(np.int64).view(np.uint64) * ODD[0]
    h = (h ^ (h >> np.uint64(32))) * ODD[1]
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.concatenate([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]).astype(np.int64).reshape(PROBES, -1)


def bloom_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the column doc_id, as bytes; tasks' filters are joined part by part."""
    size = bits // 8 // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, dtype="u1")
        for b in batches:
            at = probes(b.column("doc_id").to_numpy(), bits).ravel()
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype("u1"))
        cells = [zlib.compress(own[k * size : (k + 1) * size].tobytes(), 1) for k in range(CHUNKS)]
        yield pa.RecordBatch.from_pydict({"chunk": list(range(CHUNKS)), "cells": cells}, schema=pa.schema([("chunk", pa.int32()), ("cells", pa.binary())]))

    def either(group: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype="u1")
        for c in group["cells"].to_pylist():
            total |= np.frombuffer(zlib.decompress(c), dtype="u1")
        return pa.table({"chunk": group["chunk"][:1], "cells": pa.array([total.tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, dtype="u1")
    for r in ids.select("doc_id").mapInArrow(run, "chunk int, cells binary").groupBy("chunk").applyInArrow(either, "chunk int, cells binary").collect():
        whole[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(bytes(r["cells"]), dtype="u1")
    return whole


def sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, clashes: frozenset[int] = frozenset()) -> str:
    """The table (node, set) of the nodes in ``wanted``, from one reading of the texts, without a shuffle of them; dealt by node once and for all.

    A Bloom filter says which documents to take. It has BLOOM bits for each, up to a fixed size; where that is
    too small, more sets are made than are needed, and the join with ``wanted`` drops them.
    """
    need = stored(wanted.distinct().join(nodes.select("node", "doc_id", "n"), "node"))
    count, shingles = need.agg(F.count(F.lit(1)), F.sum("n")).first()
    bits = 1 << min(MOST_BITS, max(16, (BLOOM * count).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(need, bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for b in batches:
            at = probes(b.column("doc_id").to_numpy(), bits)
            own = b.filter(pa.array(((shared.value[at >> 3] >> (at & 7).astype("u1")) & 1).all(axis=0)))
            found = {set_name(s, clashes): s for t in own.column("text").to_pylist() if len(s := sh.shingles(t))}
            held = [s.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :].tobytes() for s in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(held, pa.binary())], ["node", "set"])

    # With fewer buckets than shuffles have partitions, Spark would deal the table anew for every join.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (shingles or 0) * KEPT // BUCKET_BYTES)
    # One shuffle, by node, for the join with what is wanted, for dropping what several tasks wrote, and for the table.
    made = docs.mapInArrow(sets, "node long, set binary").repartition(buckets, "node")
    whole = stored_by(made.join(need.select("node"), "node", "left_semi").dropDuplicates(["node"]), "node", buckets)
    discard(need)
    return whole


def read_set(raw: bytes) -> np.ndarray:
    kept = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEPT)
    return np.pad(kept, ((0, 0), (8 - KEPT, 0))).view(np.uint64).ravel()


def verify(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b), by the size of the whole sets' intersection."""
    # A node's partners are dealt to groups of TOGETHER; its own set goes to each of them once.
    many = pairs.groupBy("a").count().withColumn("__groups", (F.col("count") / TOGETHER).cast("long") + 1).drop("count")
    dealt = pairs.join(many, "a").withColumn("group", F.pmod(F.xxhash64("b"), "__groups")).select("a", "b", "group")
    hubs = dealt.select("a", "group").distinct().join(whole, F.col("a") == F.col("node")).select("a", "group", F.lit(None).cast("long").alias("b"), "set")
    partners = dealt.join(whole, F.col("b") == F.col("node")).select("a", "group", "b", "set")

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["b"].to_pylist(), group["set"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
        hub, linked = read_set(rows[0][1]), []
        for b, raw in rows[1:]:
            other = read_set(raw)
            both = len(np.intersect1d(hub, other, assume_unique=True))
            if SHARE * both >= PART * (len(hub) + len(other) - both):
                linked.append(b)
        return pa.table({"a": pa.array([group["a"][0].as_py()] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return hubs.unionByName(partners).groupBy("a", "group").applyInArrow(compare, "a long, b long")


def across(lists: DataFrame, component: DataFrame, nodes: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of long lists that are in different components and pass the filters, in blocks of a list.

    With ``forest``, a block of more than MANY pairs for each node holds components joined once it has named a pair of theirs,
    so that it names fewer pairs than it has nodes. Its list must come again: a row (token, null) says so.
    """
    known = lists.join(component, lists["node"] == component["of"], "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    mixed = known.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("m")).where("c1 <> c2")
    mixed = mixed.select("token", (F.col("m") / BLOCK).cast("long").alias("__last"))
    known = known.join(mixed, "token").join(nodes.select("node", "parts"), "node")
    rows = known.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("__last") + 1))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last")))
    rows = rows.withColumn("o", other).select("token", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "node", "n", "pos", "c", "parts")

    def block(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        cols = {k: group[k].to_numpy() for k in ("chunk", "node", "n", "pos", "c")}
        cols["parts"] = read_parts(group["parts"].to_pylist())
        cols["coarse"] = cols["parts"].reshape(-1, 64, PARTS // 64).sum(axis=2)
        by = lambda own: {k: v[own] for k, v in cols.items()}
        cols["c"] = np.unique(cols["c"], return_inverse=True)[1]
        x, y = by(cols["chunk"] == i), by(cols["chunk"] == j)
        order = np.argsort(y["n"], kind="stable")
        y = {k: v[order] for k, v in y.items()}

        def candidates(most_pairs: float, spanning: bool) -> tuple[list, list] | None:
            tree, a, b, total = np.arange(cols["c"].max() + 1), [], [], 0
            for r in range(len(x["node"])):
                n, own = int(x["n"][r]), tree[x["c"][r]]
                lo, hi = np.searchsorted(y["n"], -(-PART * n // SHARE)), np.searchsorted(y["n"], SHARE * n // PART, side="right")
                part = slice(lo, hi)
                rest = 1 + np.minimum(n - x["pos"][r] - 1, y["n"][part] - y["pos"][part] - 1)
                ok = (tree[y["c"][part]] != own) & (rest >= needed(n, y["n"][part])) & ((y["node"][part] > x["node"][r]) | (i != j))
                at = lo + np.flatnonzero(ok)
                most = n + y["n"][at] - 2 * needed(n, y["n"][at])
                for sight in ("coarse", "parts"):  # the suffix filter, in two steps
                    apart = np.abs(y[sight][at] - x[sight][r]).sum(axis=1)
                    near = apart <= most
                    at, most, apart = at[near], most[near], apart[near]
                if spanning and len(at):  # the nearest of each tree
                    at = at[np.lexsort((y["node"][at], apart / most.clip(1)))]
                    trees, first = np.unique(tree[y["c"][at]], return_index=True)
                    at = at[first]
                    tree[np.isin(tree, trees)] = own
                total += len(at)
                if total > most_pairs:
                    return None
                a.append(np.full(len(at), x["node"][r]))
                b.append(y["node"][at])
            return a, b

        again = False
        if (found := candidates(MANY * len(cols["node"]) if forest else np.inf, False)) is None:
            found, again = candidates(np.inf, True), True
        p = pairs_table(np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else {"a": [], "b": []}
        return pa.table({"a": pa.array([*p["a"], *[group["token"][0].as_py()] * again], pa.int64()), "b": pa.array([*p["b"], *[None] * again], pa.int64())})

    return rows.groupBy("token", "i", "j").applyInArrow(block, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the smallest doc_id reachable by links, its own included.

    Null and empty texts and texts without a word have n_shingles 0 and link with nothing. Rows that share a
    doc_id are one document where links are followed. A row without a doc_id is compared with nothing; its component is null.
    """
    rows = texts(docs, doc_id, text)
    described = stored(describe(rows))
    each = described.where("chunk is null").select("doc_id", "n", "node", "second", "parts")
    real = each.where("doc_id is not null and n > 0")
    same = real.groupBy("node").agg(F.min("second").alias("s1"), F.max("second").alias("s2")).where("s1 <> s2")
    # Names that two sets share: some n^2 / 2^65 of n sets, so none below a thousand million. Their sets take the second name.
    clashes = frozenset(r["node"] for r in same.select("node").collect())
    if clashes:
        each = each.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("second")).otherwise(F.col("node")))
        real = each.where("doc_id is not null and n > 0")
    nodes = stored(real.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("parts").alias("parts")))
    rows = rows.where("doc_id is not null and text is not null")
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    entries = prefixes(rows, sketch_of(described), max(16, shingles // 4 // BUCKET), clashes)
    met = stored(entries.groupBy("bucket", "salt").applyInArrow(meet, "a long, b long, n long, pos long, token long"))
    pairs = stored(suffix_filter(met.where("b is not null").select("a", "b").distinct(), nodes))
    lists = met.where("b is null").select("token", F.col("a").alias("node"), "n", "pos")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(lists.select("node"))
    sets = sets_of(wanted, rows, nodes, clashes)
    whole = docs.sparkSession.table(sets)
    links, used = stored(verify(pairs, whole)), [met, pairs]
    for forest in (True, False) if not lists.isEmpty() else ():
        so_far = connected_components(links).select(F.col("node").alias("of"), "component")
        found = stored(across(lists, so_far, nodes, forest))
        used.append(found)
        pairs = found.where("b is not null")
        if not pairs.isEmpty():
            links = links.unionByName(stored(verify(pairs, whole)))
        again = found.where("b is null").select(F.col("a").alias("token")).distinct()
        if again.isEmpty():
            break
        lists = lists.join(again, "token", "left_semi")
    # Links between sets as links between documents; documents of one set link to its first one.
    first = nodes.select(F.col("node"), F.col("doc_id").alias("d"))
    edges = links.join(first.select(F.col("node").alias("a"), F.col("d").alias("d1")), "a").join(first.select(F.col("node").alias("b"), F.col("d").alias("d2")), "b")
    own = real.join(first, "node").where("doc_id <> d").select(F.col("doc_id").alias("a"), F.col("d").alias("b"))
    found = connected_components(edges.select(F.col("d1").alias("a"), F.col("d2").alias("b")).unionByName(own)).withColumnRenamed("node", "of")
    discard(*used, links, nodes)
    drop_stored(docs.sparkSession, sets)
    return each.join(found, each["doc_id"] == found["of"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: doc_id, n_shingles, component_id."""
    return near_duplicates(table(spark, sf_dir, "documents"))
