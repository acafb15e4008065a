"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: it resolves, for a whole batch
of pre-tokens at once, those that are vocabulary entries. Tier two takes the misses and
merges their bytes with a heap over a linked list, O(n log n) for a pre-token of n bytes.
Spark deals the texts; a task sees one Arrow batch at a time and resolves each distinct
pre-token once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Distinct pre-tokens that a worker remembers; beyond that it starts anew.
MEMO = 400_000


class MinimalPerfectHash:
    """Hash and displace: n keys to n slots with no gap. Unknown keys are told by comparing the key stored in the slot."""

    LOAD = 4
    BLOCK = 128

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // self.LOAD)
        h = self._hash(keys)
        bucket, a, b = self._parts(h)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.displace = np.zeros(self.buckets, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        slot_of = np.zeros(n, dtype=np.int64)
        sizes = np.diff(starts)
        for k in np.argsort(-sizes, kind="stable"):
            own = order[starts[k] : starts[k + 1]]
            if len(own) < 2:
                break
            tried = 0
            while True:  # a block of displacements at a time; the first that puts all keys in free slots
                d = np.arange(tried, tried + self.BLOCK)[:, None]
                slots = self._slots(a[own], b[own], d)
                fits = free[slots].all(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    at = int(np.argmax(fits))
                    break
                tried += self.BLOCK
            free[slots[at]] = False
            slot_of[own] = slots[at]
            self.displace[k] = tried + at
        # Keys alone in their bucket take the slots that are left, written as -1 - slot.
        alone = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)
        slot_of[order[starts[alone]]] = left
        self.displace[alone] = -1 - left
        self.keys: list[bytes] = [b""] * n
        self.index = np.zeros(n, dtype=np.int64)
        for i, s in enumerate(slot_of.tolist()):
            self.keys[s] = keys[i]
            self.index[s] = i

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def _parts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        high = (h >> np.uint64(32)).astype(np.int64)
        return (low ^ (high >> 7)) % self.buckets, low % self.n, 1 + high % max(1, self.n - 1)

    def _slots(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (a + d * b + d * d * (d % 7 + 1)) % self.n

    def find(self, keys: list[bytes]) -> list[int]:
        """Positions of the keys, -1 for unknown ones."""
        if not keys:
            return []
        bucket, a, b = self._parts(self._hash(keys))
        d = self.displace[bucket]
        slots = np.where(d < 0, -1 - d, self._slots(a, b, d))
        return [i if self.keys[s] == k else -1 for k, s, i in zip(keys, slots.tolist(), self.index[slots].tolist(), strict=True)]


class Coder:
    """Encodes and decodes by the ranks of a .tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        entries = list(self.ranks)
        self.ids = [self.ranks[x] for x in entries]
        self.whole = MinimalPerfectHash(entries)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Byte pairs of lowest rank first, leftmost among equals, until none is in the vocabulary."""
        n, ranks = len(word), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # part i is word[i:end[i]]; 0 once merged into another
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != to:
                continue  # one of the two has changed since
            end[i], end[j] = to, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(word[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        found, i = [], 0
        while i < n:
            found.append(ranks[word[i : end[i]]])
            i = after[i]
        return tuple(found)

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.memo]
        words = [t.encode() for t in new]
        for t, w, at in zip(new, words, self.whole.find(words), strict=True):
            self.memo[t] = (self.ids[at],) if at >= 0 else self.merge(w)

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.learn(set(tokens))
        return list(chain.from_iterable(map(self.memo.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One per worker process and vocabulary."""
    return Coder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; a null text is empty and has no ids. Rows keep their number, repeated ones too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [c.encode(t or "") for t in batch["text"]]})

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids decode to nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bytes": [c.decode(() if x is None else x) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns digests of both, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        written = [str(i) for i in range(max(c.bytes_of) + 1)].__getitem__
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                ids = c.encode(t or "")
                rows.append((i, len(ids), hashlib.sha256(" ".join(map(written, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document by the 50k byte-level vocabulary."""
    import public_tokenizers as public

    return round_trip_digests(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
