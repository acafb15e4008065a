"""Groups spelling variants of words: PartEnum signatures over letter multisets, equi-joined and verified.

A word is the binary vector of its (letter, how-manieth) pairs. One inserted or deleted letter
changes one component, one replaced letter two. Components are dealt to a few parts; vectors
that differ in k components agree on all but k parts, so two such words share the signature of
at least one choice of the other parts. Signatures are joined as equal keys, pairs that meet are
verified by edit distance.

Two words of one length differ by a replacement (k = 2), words whose lengths differ by one by an
insertion (k = 1); each kind has signatures of its own, which hold the length. An edit also leaves
one half of the shorter word as it is, so each signature is written once with the first and once
with the second half. What many words still share is told apart by the word itself and its forms
with one letter less: words one edit apart share one of these. So no key pairs more than
``CROWDED`` words with each other, and none is dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

SHORTEST = 6
LEAST = 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Parts of the components for words of one length (two parts may differ), and of neighbouring lengths (one may).
PARTS = {2: 4, 1: 2}
#: The how-manieth letter of a kind is told up to this.
REPEATS = 8
#: Words that share a key are paired up to this number; beyond it their forms with a letter less are the keys.
CROWDED = 500
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000

#: UTF-8 characters above ASCII other than U+00C0 to U+00FF, and the bytes that begin them.
OTHER, BEGINS = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+"), bytes([0xC2, *range(0xC4, 0xF5)])
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF of a UTF-8 text, A-Z in lower case."""
    if len(text.translate(None, BEGINS)) < len(text):
        text = OTHER.sub(b" ", text)
    return text.translate(LETTERS).split()


def code_points(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def garbled(word: bytes, by: int) -> bytes:
    """The word without its code point ``by`` % length."""
    whole = word.decode()
    at = by % len(whole)
    return (whole[:at] + whole[at + 1 :]).encode()


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", garble: int = 0, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur at least ``least`` times in all whole texts together.

    A null text has no words; a row that is repeated counts each time. With ``garble``, a run whose
    crc32(``<doc_id>:<run>``) it divides loses the code point crc32 % length (a null doc_id is written as nothing).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if n and code_points(w) >= shortest]
            counts.clear()
            return pa.record_batch([pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for i, whole in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = [w for w in runs(whole or b"") if len(w) >= shortest]
                counts.update(words)
                if garble:
                    base = crc32(b":" if i is None else b"%d:" % i)
                    for word in [w for w in set(words) if not crc32(w, base) % garble]:
                        n = words.count(word)
                        counts[word] -= n
                        counts[garbled(word, crc32(word, base))] += n
                if len(counts) > COUNTED:
                    yield passed()
        yield passed()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


Component = tuple[str, int]


def components(word: str) -> list[Component]:
    seen: Counter[str] = Counter()
    found = []
    for letter in word:
        seen[letter] += 1
        found.append((letter, min(seen[letter], REPEATS)))
    return found


def deal(counts: Iterable[tuple[Component, int]], words: int, parts: int) -> dict[Component, int]:
    """Components to parts, so that the parts tell about equally much: the dearest (in bits) first, each to the part that has least."""

    def bits(n: int) -> float:
        p = min(n / max(1, words), 1.0)
        return 0.0 if p in (0.0, 1.0) else -p * math.log2(p) - (1 - p) * math.log2(1 - p)

    load, found = [0.0] * parts, {}
    for cost, component in sorted(((bits(n), c) for c, n in counts), reverse=True):
        k = min(range(parts), key=load.__getitem__)
        found[component], load[k] = k, load[k] + cost
    return found


def component_counts(words: DataFrame) -> list[tuple[Component, int]]:
    """How many words have each component: at most ``REPEATS`` rows for each letter, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[Component] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update(set(components(word)))
        yield pa.record_batch([pa.array([c[0] for c in counts], pa.string()), pa.array([c[1] for c in counts], pa.int32()), pa.array(counts.values(), pa.int64())], ["letter", "nth", "n"])

    found = words.select("word").mapInArrow(run, "letter string, nth int, n long").groupBy("letter", "nth").agg(F.sum("n").alias("n"))
    return [((r["letter"], r["nth"]), r["n"]) for r in found.collect()]


SAME, SHORTER, LONGER = 0, 1, 2


class Signer:
    """Signatures of words as 64-bit numbers. Equal signatures of different content only cost a verification."""

    def __init__(self, dealt: dict[int, dict[Component, int]]):
        self.dealt = dealt
        self.code = {c: xxhash.xxh3_64_intdigest(f"{c[0]}{c[1]}") for own in dealt.values() for c in own}

    def chosen(self, word: list[Component], differ: int) -> list[bytes]:
        """The multiset of each choice of parts that may be the ones that agree."""
        sums, part = [0] * PARTS[differ], self.dealt[differ]
        for c in word:
            sums[part[c]] += self.code[c]
        told = [(s % 2**64).to_bytes(8, "little") for s in sums]
        return [bytes(kept) + b"".join([told[k] for k in kept]) for kept in combinations(range(PARTS[differ]), PARTS[differ] - differ)]

    def signatures(self, word: str) -> Iterator[tuple[int, int]]:
        """(signature, role): words of one length meet in the role ``SAME``, others as ``SHORTER`` and ``LONGER``."""
        own, n = components(word), len(word)
        two, one = self.chosen(own, 2), self.chosen(own, 1)
        for role, sums, shorter in ((SAME, two, n), (SHORTER, one, n), (LONGER, one, n - 1)):
            half = shorter // 2
            kind = "=" if role == SAME else "+"
            for part in (f"{kind}<{shorter}<{word[:half]}".encode(), f"{kind}>{shorter}>{word[n - (shorter - half) :]}".encode()):
                for s in sums:
                    yield xxhash.xxh3_64_intdigest(s + part) - 2**63, role


SIGNED = pa.schema([("key", pa.int64()), ("role", pa.int8()), ("word", pa.string()), ("n", pa.int64())])


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b, n_a, n_b): each pair of the words (word, n) that are one inserted, deleted or replaced code point apart, once.

    ``words`` has each word once, and is read several times: pass a stored table.
    """
    counts, total = component_counts(words), words.count()
    dealt = {differ: deal(counts, total, parts) for differ, parts in PARTS.items()}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(dealt)
        for batch in batches:
            for at in range(0, batch.num_rows, 4_000):
                part = batch.slice(at, 4_000)
                rows = [(s, role, w, n) for w, n in zip(*(c.to_pylist() for c in part.columns), strict=True) for s, role in signer.signatures(w)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SIGNED, strict=True)], schema=SIGNED)

    signed = words.select("word", "n").mapInArrow(sign, "key long, role byte, word string, n long")
    shared = signed.withColumn("sharing", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("sharing > 1")
    few, many = shared.where(F.col("sharing") <= crowded), shared.where(F.col("sharing") > crowded)
    less = F.expr("array_distinct(transform(sequence(0, length(word)), k -> if(k = 0, word, concat(left(word, k - 1), substring(word, k + 1)))))")
    many = many.withColumn("less", F.explode(less)).withColumn("key", F.xxhash64("key", "less")).drop("less")
    pairs = _verified(few).unionByName(_verified(many))
    return pairs.dropDuplicates(["a", "b"])


def _verified(keyed: DataFrame) -> DataFrame:
    """Pairs of words that share a key in fitting roles and are one edit apart."""
    left = keyed.where(F.col("role") != LONGER).select("key", F.col("role").alias("role_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = keyed.where(F.col("role") != SHORTER).select("key", F.col("role").alias("role_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    fitting = F.when(F.col("role_a") == SAME, (F.col("role_b") == SAME) & (F.col("a") < F.col("b"))).otherwise(F.col("role_b") == LONGER)
    return left.join(right, "key").where(fitting & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def group_variants(words: DataFrame, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the words (word, n), which has each word once.

    A word's form is its near word of largest n (ties: the smallest), if that is at least ``ratio`` times its own;
    else null. Its root follows forms to the last; a word without a form is its own. No words give no rows.
    """
    pairs = near_pairs(words, crowded)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n_a").alias("own"))
    taken = -F.col("best.less") >= ratio * F.col("own")
    near = stored(near.select("word", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links end. n grows at each link, so they have no rings; each round doubles how far a link reaches."""
    now = stored(links)
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        moved = not reached.where("moved").isEmpty()
        now = reached.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", garble: int = 0) -> DataFrame:
    """Words of the whole texts, each with its near words' number, its form and its root.

    Words are lower-cased runs (A-Z only) of A-Z, a-z and U+00C0 to U+00FF, of at least 6 code points, that occur at least
    5 times. Null and empty texts have none; repeated rows count each; other columns don't matter; no documents give no rows.
    """
    return group_variants(stored(count_words(docs, doc_id, text, garble)))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of ``documents``, one run in 199 of each document being garbled."""
    return spelling_variants(table(spark, sf_dir, "documents"), garble=199)
