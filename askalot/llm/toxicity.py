"""A toxicity classifier that is regularised by counterfactuals.

Logistic regression over words and word beginnings. Besides the labels' loss, training
penalises the change of a sentence's score when an identity term in it is swapped for
another one, in labelled sentences that hold such terms and in neutral ones. So a mention
of a group can't carry weight of its own.

The fit takes a bounded sample of labelled rows (SAMPLE). Executors count the features of
that sample, the FEATURES that tell most are chosen, and only their numbers reach the
driver. Scoring reads every word of every text, on executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled rows that the classifier is fitted on, at most, chosen by a hash of their id.
SAMPLE = 12_000
#: Features kept, by how much their shares among toxic and other texts differ.
FEATURES = 4_000
#: Weight of the counterfactual penalty and of the ridge.
SWAP, RIDGE = 2.0, 1e-4
#: Lengths of the word beginnings that are features, besides whole words.
STARTS = (4, 5, 6)
#: Words whose features a worker remembers; beyond that it starts anew.
MEMO = 600_000

# Identity terms; those of one line can stand for each other.
IDENTITY = [
    ["women", "men", "girls", "boys", "mothers", "fathers"],
    ["woman", "man", "girl", "boy", "mother", "father"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"],
    ["black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"],
    ["immigrants", "refugees", "foreigners", "citizens", "locals"],
    ["american", "mexican", "chinese", "indian", "russian", "turkish", "german", "french", "spanish", "polish"],
    ["old", "young", "elderly", "disabled", "blind", "deaf"],
    ["frauen", "männer", "mädchen", "jungen"], ["muslime", "christen", "juden"], ["ausländer", "flüchtlinge", "einheimische"],
    ["femmes", "hommes", "filles", "garçons"], ["musulmans", "chrétiens", "juifs"], ["étrangers", "réfugiés", "citoyens"],
    ["mujeres", "hombres", "chicas", "chicos"], ["musulmanes", "cristianos", "judíos"], ["extranjeros", "refugiados", "ciudadanos"],
]
NEUTRAL = ["many {} live in this town", "the {} teacher spoke about the book", "i talked to {} people today", "we are {} and proud of it"]

WORDS = re.compile(r"[^\W_]+").findall
SENTENCES = re.compile(r"[.!?\n]+").split
SWAPS = {term: line[(k + 1) % len(line)] for line in IDENTITY for k, term in enumerate(line)}


def word_features(word: str) -> set[str]:
    return {word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)}


def hashed(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> 1


def text_features(words: set[str]) -> list[int]:
    return sorted({hashed(f) for w in words for f in word_features(w)})


def swapped(sentence: list[str]) -> list[str]:
    return [SWAPS.get(w, w) for w in sentence]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


class Model:
    """weights: by hashed feature; bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def features(self, word: str) -> tuple[int, ...]:
        if (got := self.memo.get(word)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[word] = tuple(h for f in word_features(word) if (h := hashed(f)) in self.weights)
        return got

    def score(self, text: str | None) -> float:
        """The probability of label 1; of an empty text, that of a text without any feature."""
        if self.bias == -np.inf:
            return 0.0
        words = set(WORDS((text or "").lower()))
        own = set(chain.from_iterable(map(self.features, words)))
        z = self.bias + sum(self.weights[h] for h in sorted(own))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(features: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], chosen: np.ndarray) -> Model:
    """Logistic loss + RIDGE |w|^2 + SWAP mean over pairs of (w.x - w.x')^2, by Adam on the whole sample.

    ``chosen`` are the sorted hashes of the features; texts hold positions in it, pairs the hashes that differ.
    """
    if not len(toxic):
        return Model({}, -np.inf)
    n1, n0 = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate([*features, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    # A pair's change of features: +1 for those of the sentence alone, -1 for those of its swap alone.
    p_row = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(pairs)])
    p_name = np.concatenate([np.r_[a, b] for a, b in pairs])
    p_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs])
    p_col = np.searchsorted(chosen, p_name)

    w, bias = np.zeros(len(chosen)), np.log(n1 / n0)
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, 301):
        score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=w[col], minlength=len(toxic)), -40, 40)))
        off = (score - toxic) / len(toxic)
        g = np.bincount(col, weights=off[row], minlength=len(chosen)) + 2 * RIDGE * w
        change = np.bincount(p_row, weights=p_sign * w[p_col], minlength=len(pairs))
        g += 2 * SWAP / len(pairs) * np.bincount(p_col, weights=p_sign * change[p_row], minlength=len(chosen))
        g = np.r_[g, off.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(dict(zip(chosen.tolist(), w.tolist(), strict=True)), float(bias))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows that aren't held out. Labels other than 0 and 1 and labels without a document are passed over.

    With no labels at all, the model scores 0 throughout.
    """
    usable = labels.where(labels["toxic"].isin(0, 1) & ~held_out(labels["doc_id"])).select(labels["doc_id"].cast("long").alias("__id"), labels["toxic"].cast("int").alias("toxic"))
    few = usable.orderBy(F.xxhash64("__id"), "__id", "toxic").limit(sample)

    # ``few`` has at most ``sample`` rows of two numbers.
    rows = docs.select(docs[doc_id].cast("long").alias("__id"), docs[text].alias("text")).join(F.broadcast(few), "__id").select("text", "toxic")
    own_terms = {h for term in SWAPS for h in text_features({term})}
    chosen = np.asarray(sorted(own_terms | choose_features(rows)), dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value
        for batch in batches:
            out = []
            for t, y in zip(batch["text"], batch["toxic"], strict=True):
                low = (t or "").lower()
                words = set(WORDS(low))
                a = b = set()
                if not words.isdisjoint(SWAPS):
                    own = [s for x in SENTENCES(low) if not set(s := WORDS(x)).isdisjoint(SWAPS)]
                    a, b = (set(text_features(set(chain.from_iterable(x)))) for x in (own, map(swapped, own)))
                got = np.asarray(text_features(words), dtype=np.int64)
                at = np.minimum(np.searchsorted(names, got), len(names) - 1)
                out.append((int(y), at[names[at] == got], sorted(a - b), sorted(b - a)))
            yield pd.DataFrame(out, columns=["toxic", "features", "own", "swapped"])

    got = rows.mapInPandas(run, "toxic int, features array<int>, own array<long>, swapped array<long>").toPandas()
    pairs = list(zip(got["own"], got["swapped"], strict=True))
    for sentence in NEUTRAL:
        for term, other in SWAPS.items():
            a, b = (set(text_features(set(sentence.format(x).split()))) for x in (term, other))
            pairs.append((sorted(a - b), sorted(b - a)))
    pairs = [(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)) for a, b in pairs if len(a) or len(b)]
    return fit(got["features"].tolist(), got["toxic"].to_numpy(dtype=float), pairs, chosen)


def choose_features(rows: DataFrame) -> set[int]:
    """Hashes of the FEATURES features whose shares among toxic and other rows differ most, by their standard error."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, part in batch.groupby("toxic"):
                every = [np.asarray(text_features(set(WORDS((t or "").lower()))), dtype=np.int64) for t in part["text"]]
                name, n = np.unique(np.concatenate(every), return_counts=True)
                yield pd.DataFrame({"name": name, "n1": n * int(y), "n0": n * (1 - int(y))})

    total = {int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    t1, t0 = max(1, total.get(1, 0)), max(1, total.get(0, 0))
    p = (F.col("n1") + F.col("n0")) / (t1 + t0)
    z = F.abs(F.col("n1") / t1 - F.col("n0") / t0) / F.sqrt(p * (1 - p) * (1 / t1 + 1 / t0) + 1e-12)
    counted = rows.mapInPandas(count, "name long, n1 long, n0 long").groupBy("name").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    best = counted.where("n1 + n0 >= 3").select("name", z.alias("z")).orderBy(F.desc("z"), "name").limit(FEATURES)
    return {r["name"] for r in best.collect()}


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # FEATURES numbers or so

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [m.score(t) for t in batch["text"]]})

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInPandas(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*shared.value)
        for part in parts:
            yield pd.Series([m.score(t) for t in part], dtype=float)

    return docs.where(score(docs[text]) < limit)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
