import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askalot.llm import token_counts
from askalot.llm.common import table

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BYTES, WORDS = (public.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def want(rows, path, limit=512):
    count = library(path)
    return sorted(((i, len((t or "").encode()), n := count(t), n > limit) for i, t in rows), key=repr)


def odd_texts():
    deal = random.Random(1)
    bits = ["the", " one", "'re", "'", "  ", "\n\n", " \t ", "<|endoftext|>", "<|endo", "text|>", "ß", "😀", "é", "12345", "...", "!?", " 東京", "a" * 40, " ", "́", "\r\n"]
    return ["".join(deal.choices(bits, k=n)) for n in (50, 300, 900, 2_000, 5_000)]


def test_documents_equal_the_library(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert got(token_counts.op13_token_counts(spark, SF)) == want(rows, BYTES)


def test_spliced_texts_equal_the_library(spark):
    texts = [*odd_texts(), "x" * 9_000, "y" * 700 + " z" * 700, " " * 3_000 + "end", "<|endoftext|>" * 300, "don't " * 900, "", None, "short", odd_texts()[2]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[1]), (2, texts[2]), (2, texts[2])]
    docs = spark.createDataFrame([(i, t, 7, "k", "w") for i, t in rows], "doc_id long, text string, n_tokens long, key string, whole string")
    assert got(token_counts.count_tokens(docs, BYTES, chunk=200, overlap=20)) == want(rows, BYTES)
    assert token_counts.count_tokens(docs.limit(0), BYTES).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    rows = [(1, "Hello  WORLD " * 400), (2, "<|endoftext|> x"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(token_counts.count_tokens(docs, WORDS, chunk=64, overlap=16)) == want(rows, WORDS)
    assert not token_counts.Words(WORDS).spliced and token_counts.Words(BYTES).spliced


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 120, 1_000])
def test_chunks_cover_and_overlap(length):
    parts = token_counts.chunks(length, 64, 16)
    assert parts[0][0] == 0 and parts[-1][1] == length and all(b[0] == a[1] - 16 for a, b in zip(parts, parts[1:], strict=False)) and all(b - a <= 64 for a, b in parts)
    assert [b == length for _, b in parts] == [False] * (len(parts) - 1) + [True]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " b", "'", "'ll", " ", "\n", "<|endoftext|>", "<|", "é", "9", "!", "\t\t", "😀 ", " "]), max_size=60).map("".join), st.integers(0, 60), st.integers(30, 90))
def test_a_place_that_both_have_is_one_of_the_text(text, start, end):
    """Neighbours that begin anywhere: the words of the right one from a common place on are those of the whole text."""
    w = token_counts.words_of(BYTES)
    left, right = text[:end], text[start:]
    if len(left) <= start:
        return
    total, at, before = w.places(text)
    whole = dict(zip(at.tolist(), before.tolist(), strict=True))
    n, starts, counted = w.places(left)
    mine = {p: b for p, b in zip(starts.tolist(), counted.tolist(), strict=True) if p <= len(left) - w.margin}
    m, starts, counted = w.places(right)
    theirs = {p + start: b for p, b in zip(starts.tolist(), counted.tolist(), strict=True)}
    for place in mine.keys() & theirs.keys():
        assert whole.get(place) == mine[place] and mine[place] + m - theirs[place] == total


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("'sdl \n\r\t\u00a0\u2003\u2028\x1c\x85²½ßœ"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_remembered_words_equal_the_library(text):
    w = token_counts.words_of(BYTES)
    e = w.tokenizer.encode(text, add_special_tokens=False)
    assert list(w.counts([text])) == [len(e)] and w.places(text)[0] == len(e)
