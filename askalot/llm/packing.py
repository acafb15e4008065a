"""Best-fit packing of tokenised documents into sequences of a fixed length.

Texts become pieces of at most MAX tokens; their length histogram (MAX numbers, whatever
the corpus) goes to the driver. There, patterns of lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares
and rounded down, and what is left is packed best-fit, longest first, into the room that
the patterns leave and into further sequences. The
result is a plan: "of the pieces of length L, those ranked a..b go to sequences s.. at
offset o". Ranking and placing every piece is Spark's work again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

MAX = 2048
#: Distinct words that a worker remembers; beyond that it starts anew.
MEMO = 600_000
#: Pieces of one length that one task ranks, about.
RANKED = 100_000


#: A word of letters that neither NFC nor lower-casing changes, and ASCII marks after it. No tokenizer pattern joins the two.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Texts whose new words are looked up together.
TOGETHER = 256


def tokenizer(path: str):
    # Spark runs a task for each core already; threads of the library would each keep memory of their own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def merges_only(path: str):
    """The tokenizer without its normaliser and pre-tokenizer, if those are the usual ones of a byte-level BPE over words; else None."""
    from tokenizers import Tokenizer

    spec = json.loads(Path(path).read_text())
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, each distinct word encoded once.

    For tokenizers that ignore case and never join characters across white space, as the word-level BPE here.
    """

    def __init__(self, path: str):
        self.whole, self.merges, self.letters = tokenizer(path), merges_only(path), byte_letters()
        self.memo: dict[bytes, bytes] = {}

    def _put(self, keys: list[bytes], encoder, written: list[str]) -> None:
        got = encoder.encode_batch_fast(written, add_special_tokens=False)
        self.memo.update((k, array("I", e.ids).tobytes()) for k, e in zip(keys, got, strict=True))

    def _learn(self, words: set[bytes]) -> None:
        memo, plain, stems, others = self.memo, [], set(), set()
        for w in words:
            if w in memo:
                continue
            m = PLAIN.fullmatch(w.decode()) if self.merges else None
            if m is None:
                others.add(w)
                continue
            stem, tail = m[1].encode(), m[2].encode()
            if stem not in memo:
                stems.add(stem)
            if tail:
                plain.append((w, stem, tail))
                if tail not in memo:
                    others.add(tail)
        if others:
            keys = list(others)
            self._put(keys, self.whole, [w.decode() for w in keys])
        if stems:
            keys = list(stems)
            self._put(keys, self.merges, [w.decode("latin-1").translate(self.letters) for w in keys])
        memo.update((w, memo[stem] + memo[tail]) for w, stem, tail in plain)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), TOGETHER):
            words = [t.encode().lower().split() for t in texts[at : at + TOGETHER]]  # ASCII lower case and white space
            if len(self.memo) > MEMO:
                self.memo.clear()
            self._learn(set(chain.from_iterable(words)))
            for w in words:
                yield b"".join(map(self.memo.__getitem__, w))


def tokenised_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = MAX, separator: int = 0) -> DataFrame:
    """Pieces of every text's ids, each text closed by ``separator``: doc_id, piece, start, length, ids_crc32.

    A null text is empty: one piece with the separator alone. Only texts of more than ``size`` ids are cut.
    """
    end = np.asarray([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds(path)  # one for each task, so that a worker keeps nothing between stages
        for batch in batches:
            rows = []
            for i, own in zip(batch["doc_id"], ids.encode_all([t or "" for t in batch["text"]]), strict=True):
                whole = own + end
                for p, at in enumerate(range(0, len(whole), 4 * size)):
                    part = whole[at : at + 4 * size]
                    rows.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


Pattern = tuple[tuple[int, int], ...]


def patterns(lengths: np.ndarray, size: int, grid: int = 24) -> list[Pattern]:
    """Patterns, each (length, times) longest first: one to three of the lengths, or one or two short ones repeated, then filled up.

    A pattern is filled with the longest length that fits, as often as it fits, until none does. The second length
    comes from at most ``grid`` evenly spaced ones, so there are at most (2 grid + 3) x len(lengths) patterns.
    """
    have = np.zeros(size + 1, dtype=np.int64)
    have[lengths] = lengths
    best = np.maximum.accumulate(have).tolist()  # the longest length that fits a room; 0 for none
    out = set()

    def add(*parts: tuple[int, int]) -> None:
        times: dict[int, int] = {}
        room = size
        for a, n in parts:
            times[a] = times.get(a, 0) + n
            room -= a * n
        while c := best[room]:
            times[c] = times.get(c, 0) + room // c
            room %= c
        out.add(tuple(sorted(times.items(), reverse=True)))

    middle = lengths[np.unique(np.linspace(0, len(lengths) - 1, grid).astype(int))] if len(lengths) else lengths
    for a in lengths.tolist():
        if 4 * a <= size or not best[size % a]:
            add((a, size // a))
        add((a, 1), *([(b, 1)] if (b := best[size - a]) else []))
        for m in middle[middle + a <= size].tolist():
            add((a, 1), (m, 1), *([(c, 1)] if (c := best[size - a - m]) else []))
            if 4 * max(a, m) <= size:
                add((a, size // (a + m)), (m, size // (a + m)))
    return sorted(out, reverse=True)


def fit_counts(pats: list[Pattern], histogram: np.ndarray, size: int, steps: int = 400) -> np.ndarray:
    """Non-negative least squares ||A x - h|| by accelerated projected gradient; A counts each pattern's lengths, room left costs a little."""
    rows, times = np.asarray([part for p in pats for part in p], dtype=np.int64).T
    cols = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    # Longer pieces weigh more: they are harder to place among the residuals.
    weight = np.sqrt(np.arange(len(histogram)) / size)
    room = np.asarray([size - sum(a * n for a, n in p) for p in pats]) / size
    forward = lambda x: np.bincount(rows, weights=x[cols] * times, minlength=len(histogram)) * weight
    backward = lambda r: np.bincount(cols, weights=(r * weight)[rows] * times, minlength=len(pats))
    target = histogram * weight
    probe = np.ones(len(pats))
    for _ in range(20):
        probe = backward(forward(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / max(1e-9, np.linalg.norm(backward(forward(probe))) * 1.05)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * (backward(forward(y) - target) + room))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def best_fit(counts: dict[int, int], size: int, first: int, opened: list[tuple[int, int, int]] = ()) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of equal lengths. Sequences that are alike are handled as one range.

    ``opened``: sequences that are begun, as (room, first sequence, how many).

    Returns (length, pieces, first sequence, pieces of this length in each sequence, offset) rows, in the order
    in which they take the pieces of a length, and the next free sequence number.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, how many)]
    rooms: list[int] = []  # sorted
    placed = []

    def give(room: int, base: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            free[room].append((base, n))

    for begun in opened:
        give(*begun)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = int(np.searchsorted(rooms, length))
            if at == len(rooms):
                each = size // length
                base, n, room = first, -(-left // each), size
                first += n
            else:
                room = rooms[at]
                base, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                placed.append((length, full * each, base, each, size - room))
                give(room - each * length, base, full)
                left -= full * each
                base, n = base + full, n - full
            if n and left:  # the last one takes fewer
                placed.append((length, left, base, left, size - room))
                give(room - left * length, base, 1)
                base, n, left = base + 1, n - 1, 0
            give(room, base, n)
    return placed, first


def fit(counts: dict[int, int], size: int = MAX) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], dict[int, int], int]:
    """The fitted patterns, placed as ``best_fit`` places; the sequences they leave open; the counts left; the next free sequence."""
    left, placed, opened, first = dict(counts), [], [], 0
    if not counts:
        return placed, opened, left, first
    dense = np.zeros(size + 1)
    for k, n in counts.items():
        dense[k] = n
    pats = patterns(np.asarray(sorted(counts), dtype=np.int64), size)
    times = np.floor(fit_counts(pats, dense, size) + 1e-6).astype(np.int64)
    for k in np.argsort(-times, kind="stable"):
        n = min(int(times[k]), *(left[a] // each for a, each in pats[k]))
        if n > 0:
            at = 0
            for a, each in pats[k]:
                placed.append((a, n * each, first, each, at))
                at += a * each
                left[a] -= n * each
            opened.append((size - at, first, n))
            first += n
    return placed, opened, {k: n for k, n in left.items() if n}, first


def fitted_share(counts: dict[int, int], size: int = MAX) -> float:
    """The share of the pieces that fitted patterns place."""
    return sum(row[1] for row in fit(counts, size)[0]) / max(1, sum(counts.values()))


def make_plan(histogram: dict[int, int], size: int = MAX) -> pd.DataFrame:
    """Where the pieces of each length go: length, from_rank, to_rank, sequence, each, offset.

    The fitted patterns first, then the residuals, best-fit into the room of the patterns and into further
    sequences. A plan has a few rows for each length, whatever the number of pieces.
    """
    placed, opened, left, first = fit({int(k): int(n) for k, n in histogram.items() if n}, size)
    rows = placed + best_fit(left, size, first, opened)[0]
    plan = pd.DataFrame(rows, columns=["length", "pieces", "sequence", "each", "offset"]).astype("int64")
    plan["to_rank"] = plan.groupby("length")["pieces"].cumsum()
    plan["from_rank"] = plan["to_rank"] - plan["pieces"]
    return plan[["length", "from_rank", "to_rank", "sequence", "each", "offset"]]


def pack(pieces: DataFrame, size: int = MAX) -> DataFrame:
    """``pieces`` (doc_id, piece, length 1..size, and others) with ``sequence_id`` and ``offset``: each sequence is gapless from 0.

    ``pieces`` is read three times: materialise it first. Rows that repeat are placed one by one.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = make_plan(histogram, size)
    # A rank within a length: by slices of about RANKED pieces, then the slices' counts are summed up.
    slices = spark.createDataFrame(
        pd.DataFrame({"length": list(histogram), "__slices": [max(1, -(-n // RANKED)) for n in histogram.values()]}), "length long, __slices long"
    )
    dealt = pieces.join(F.broadcast(slices), "length").withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece"), "__slices"))
    ahead = (
        dealt.groupBy("length", "__slice")
        .count()
        .withColumn("__ahead", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("length", "__slice", "__ahead")
    )
    place = spark.createDataFrame(plan, "length long, from_rank long, to_rank long, sequence long, each long, offset long").withColumnRenamed("length", "__length")
    ranked = (
        dealt.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__slice").orderBy("doc_id", "piece")))
        .join(ahead, ["length", "__slice"])
        .withColumn("__rank", F.col("__ahead") + F.col("__row") - 1)
    )
    inside = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("from_rank")) & (F.col("__rank") < F.col("to_rank"))
    # The plan's size is bounded by ``size`` and the pattern grid, not by the corpus.
    return ranked.join(F.broadcast(place), inside).select(
        *[F.col(c) for c in pieces.columns],
        (F.col("sequence") + F.floor((F.col("__rank") - F.col("from_rank")) / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + F.pmod(F.col("__rank") - F.col("from_rank"), F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = MAX) -> DataFrame:
    """Tokenises and packs every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(tokenised_pieces(docs, path, doc_id, text, size))
    return pack(pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    import public_tokenizers as public

    return pack_documents(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"))
