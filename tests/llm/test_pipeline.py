"""The pipeline against plain Python, stage by stage."""

import re

import pytest

import corpus_pipeline
from askalot.llm import toxicity
from askalot.llm.line_dedup import MIN_SITES

public = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def without_boilerplate(rows):
    sites, first = {}, {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if key := line.strip(" "):
                sites.setdefault(key, set()).update({r["source"]} - {None})
                place = (r["doc_id"] is None, r["doc_id"] or 0)
                first[key] = min(first.get(key, place), place)
    for r in rows:
        if r["text"] is None:
            continue
        own = (r["doc_id"] is None, r["doc_id"] or 0)
        kept = [x for x in r["text"].split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < MIN_SITES or first[x.strip(" ")] == own]
        r["text"] = "\n".join(kept)
    return rows


def shingles(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def first_of_each_group(rows):
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [r for r in rows if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"]]


def test_every_stage_equals_plain_python(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = "a long line of words that goes on " * 1500
    more = [(900_001, None, "en", "s1", 0), (900_002, "", "en", None, 0), (None, "no id here, but some words all the same", None, "s2", 39), (900_003, long, "en", "s3", len(long)), (900_004, long + "end", "en", "s4", len(long) + 3)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    as_rows = lambda df: [r.asDict() for r in df.collect()]
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in rows)
    model = toxicity.train(docs, labels)
    want, now = as_rows(docs), docs
    plain = {
        "toxicity": lambda rows: [r for r in rows if model.score(r["text"]) < 0.5],
        "line_dedup": without_boilerplate,
        "ngram_join": first_of_each_group,
    }
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        before, want = len(want), plain[name](want)
        assert now.columns == docs.columns and key(as_rows(now)) == key(want), name
        if name == "ngram_join":
            assert len(want) < before
    assert all(r["n_chars"] == len(r["text"]) for r in as_rows(now) if r["text"] is not None)
    ids = packed_ids(want)
    got = as_rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    total = {}
    for r in got:
        total.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in total.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = {}
    for r in got:
        lengths.setdefault(r["doc_id"], []).append(r["length"])
    assert {k: sum(v) for k, v in lengths.items()} == ids


def packed_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    t.encode_special_tokens = True
    return {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows}


def test_empty_tables_go_through(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
