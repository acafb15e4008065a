"""Token counts of texts by a tokenizer file; huge documents by overlapping chunks that are spliced where they resynchronise.

Documents up to a limit are encoded whole. A longer one becomes overlapping chunks, each a row that any
task can encode. A chunk reports, for its overlaps, where words (pre-tokens) begin and how many tokens
of it stand before. Two neighbours are spliced where both begin a word; what the left one has
beyond and the right one before is taken off the sum.

Such a place is proven, not only likely: a byte-level pattern matches from left to right without looking back, so from a
common place on the right chunk has what the whole text has. The left chunk has it up to the place, by
the same argument from its own splice, as the pattern and special strings look ahead less than ``MARGIN`` characters,
which the place keeps from the left chunk's end. Where neighbours have no common place
(a word longer than the overlap), the document is done again with overlaps and chunks ``WIDEN`` times as long, at
last as one chunk.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Characters up to which a document is encoded whole, and then of each chunk.
CHUNK = 32_768
OVERLAP = 256
WIDEN = 8
#: No match depends on more characters behind its end than this: three for a contraction, one for a look-ahead.
LOOKS_AHEAD = 4
#: Chunks that are written together.
TOGETHER = 64
#: Distinct words that a worker remembers; beyond that it starts anew.
MEMO = 800_000
# Fixed value: the words of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Finds characters beyond those whose class (letter, number, space, other) is the same in every version of Unicode.
UNSURE = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u2026\u20ac]").search


class Words:
    """A tokenizer that tells tokens and words. ``spliced``: whether its words are those of the byte-level pattern, for which places are proven."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
        from tokenizers import Tokenizer, processors

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets with the spaces before words
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        simple = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word")) for a in added) and not any(_overlap(a["content"], b["content"]) for a in added for b in added)
        self.spliced = simple and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")
        self.margin = max([LOOKS_AHEAD, *(len(a["content"]) for a in added)])

        self.plain = self.spliced and regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in added) or "(?!)").search
        self.memo: dict[str, int] = {}

    def counted(self, text: str) -> tuple[list[str], list[int]] | None:
        """The words of a text and how many tokens each has: a word is encoded once and remembered. None for texts with a special string, or characters that Unicode's versions may class differently."""
        if not self.plain or UNSURE(text) or self.special(text):
            return None
        words, memo = self.plain(text), self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            if len(memo) > MEMO:
                memo.clear()
                new = list(set(words))
            memo.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return words, list(map(memo.__getitem__, words))

    def counts(self, texts: list[str]) -> Iterator[int]:
        for text in texts:
            own = self.counted(text)
            yield sum(own[1]) if own else len(self.tokenizer.encode(text, add_special_tokens=False))

    def places(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens; where words begin, in characters; how many tokens stand before each."""
        own = self.counted(text)
        if own:
            return sum(own[1]), np.cumsum([0, *map(len, own[0][:-1])]), np.cumsum([0, *own[1][:-1]])
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.fromiter((-1 if w is None else w for w in e.word_ids), dtype=np.int64, count=len(e))
        starts = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e))
        first = np.flatnonzero(np.diff(words, prepend=-2) != 0)
        return len(e), starts[first], first


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One per worker process."""
    return Words(path)


def _overlap(a: str, b: str) -> bool:
    """Whether an occurrence of ``b`` could begin inside one of ``a``."""
    return any(b.startswith(a[k:]) or a[k:].startswith(b) for k in range(1, len(a)))


def chunks(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks that cover 0..length; neighbours share ``overlap`` characters."""
    if length <= chunk:
        return [(0, length)]
    step = chunk - overlap
    return [(at, min(at + chunk, length)) for at in range(0, length - overlap, step)]


def _whole(docs: DataFrame, path: str, result: str = "n_tokens") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            n = list(words.counts(batch.column(2).to_pylist()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", result])

    return docs.mapInArrow(run, f"doc_id long, n_bytes long, {result} long")


def _cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """A row for each chunk of each (key, text): key, k (its number), at (its start), last, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = chunks(len(text), chunk, overlap)
                for some in range(0, len(parts), TOGETHER):
                    own = parts[some : some + TOGETHER]
                    rows = [[key] * len(own), list(range(some, some + len(own))), [a for a, _ in own], [b == len(text) for _, b in own], [text[a:b] for a, b in own]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["key", "k", "at", "last", "text"])

    return docs.select("key", "text").mapInArrow(run, "key string, k long, at long, last boolean, text string")


ENCODED = "key string, k long, total long, left_at array<long>, left_before array<long>, right_at array<long>, right_before array<long>"


def _encoded(parts: DataFrame, path: str, overlap: int) -> DataFrame:
    """Tokens of each chunk, and the places of its left and right overlap, from the start of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            for key, k, at, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, starts, before = words.places(text)
                left = starts <= (overlap if k else -1)
                right = (starts >= len(text) - overlap) & (starts <= len(text) - words.margin) if not last else np.zeros(len(starts), dtype=bool)
                found = [[key], [k], [total], [starts[left] + at], [before[left]], [starts[right] + at], [before[right]]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4), strict=True)], ["key", "k", "total", "left_at", "left_before", "right_at", "right_before"])

    return parts.mapInArrow(run, ENCODED)


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): null where two neighbours have no place in common."""
    right = encoded.select("key", (F.col("k") - 1).alias("k"), F.col("left_at").alias("next_at"), F.col("left_before").alias("next_before"))
    place = F.array_max(F.array_intersect("right_at", "next_at"))
    pairs = encoded.join(right, ["key", "k"]).withColumn("place", place)
    behind = F.col("total") - F.element_at("right_before", F.array_position("right_at", F.col("place")).cast("int"))
    off = F.when(F.col("place").isNotNull(), behind + F.element_at("next_before", F.array_position("next_at", F.col("place")).cast("int")))
    taken = pairs.select("key", (-off).alias("n"))
    every = encoded.select("key", F.col("total").alias("n")).unionByName(taken)
    return every.groupBy("key").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def _long(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) for each key of the long texts (key, text), whose equal texts have equal keys."""
    done, left = None, docs
    while True:
        parts = _cut(left, chunk, overlap).dropDuplicates(["key", "k"])  # deals the chunks of a document to many tasks
        encoded = stored(_encoded(parts, path, overlap))
        found = stored(_spliced(encoded))
        discard(encoded)
        here = found.where("n_tokens IS NOT NULL")
        done = here if done is None else done.unionByName(here)
        failed = found.where("n_tokens IS NULL")
        if failed.isEmpty():
            return done
        left = docs.join(failed.select("key"), "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def count_tokens(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row: UTF-8 bytes and tokens of the whole text, without added ones; special strings count as the tokenizer takes them.

    A null text is empty and has none of either; rows keep their number, repeated ones and those without an id too; no rows give none. Tokenizers
    whose words aren't those of the byte-level pattern, for which splicing isn't proven, encode each text whole.
    """
    if chunk < 2 * overlap or overlap < 16:
        raise ValueError("chunks must be twice as long as their overlaps, and these of 16 characters or more")
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    if words_of(path).spliced:
        # A text of at most that many bytes has at most that many characters.
        short, long = rows.where(F.col("n_bytes") <= chunk), rows.where(F.col("n_bytes") > chunk)
        long = stored(long.withColumn("key", F.sha2(F.col("text").cast("binary"), 256)))
        counted = _long(long, path, chunk, overlap)
        counts = _whole(short, path).unionByName(long.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens"))
    else:
        counts = _whole(rows, path)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` by the byte-level vocabulary, and whether they exceed 512."""
    import public_tokenizers as public

    return count_tokens(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"))
