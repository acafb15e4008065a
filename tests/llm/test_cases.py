"""Cases that all operators share: other columns of any name, repeated rows, very long texts."""

import pytest

from askalot.llm import ann, byte_bpe, centroids, exact_dedup, html_extract, license_scan, ngram_join, packing, spelling, token_counts, toxicity

public = pytest.importorskip("public_tokenizers")
EXTRA = ["__id", "__row", "__len", "__text", "__digit", "node", "second", "parts", "key", "k", "n", "word", "role", "a", "b", "id", "score", "label", "piece", "start", "length", "text_sha256", "n_tokens", "rank", "leaf", "query_id", "q", "cluster", "html_", "license", "features", "x y"]


def given(spark, rows, schema, extra):
    made = [(*r, *([f"{c}-{k}" for c in EXTRA] if extra else [])) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, schema + (", " + ", ".join(f"`{c}` string" for c in EXTRA) if extra else ""))


@pytest.fixture(scope="module")
def model(spark):
    texts = [(k, f"this {'idiot' if k % 4 == 0 else 'person'} reads book {k}.") for k in range(200)]
    return toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in texts], "doc_id long, toxic int"))


TEXTS = [(k, f"word{k % 3} letters of an article that says something again and again MIT License {k % 3}") for k in range(9)] + [(None, None), (3, ""), (7, "all rights reserved " * 4_000), (7, "all rights reserved " * 4_000), (8, "you idiot " * 20_000)]
VECTORS = [(k, [float(k % 5), float(k % 3), 1.0, 0.5 * k]) for k in range(40)] + [(40, None), (41, [1.0]), (3, [3.0, 0.0, 1.0, 1.5])]


def operators(model):
    return {
        "op1": lambda d: ann.search(d, lambda i: i % 10 == 0, 5), "op2": lambda d: packing.pack_documents(d, public.path("word_bpe_49k.json")).drop("sequence_id", "offset"),
        "op3": lambda d: byte_bpe.round_trip_digests(d, public.path("byte_bpe_50k.tiktoken"), public.PATTERN), "op5": lambda d: toxicity.score_documents(d, model),
        "op6": ngram_join.near_duplicates, "op8": exact_dedup.mark_duplicates, "op10": lambda d: license_scan.scan_licenses(d).select("doc_id", "text", "license_rules", "license_sentences"),
        "op11": lambda d: spelling.spelling_variants(d, garble=5), "op12": lambda d: centroids.quantised(d, 4), "op13": lambda d: token_counts.count_tokens(d, public.path("byte_bpe_50k.json"), chunk=4_096),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op8", "op10", "op11", "op12", "op13"])
def test_other_columns_change_nothing(spark, model, name):
    run = operators(model)[name]
    rows, schema = (VECTORS, "vec_id long, embedding array<double>") if name in ("op1", "op12") else (TEXTS, "doc_id long, text string")
    plain, clashing = ([tuple(r) for r in run(given(spark, rows, schema, extra)).collect()] for extra in (False, True))
    assert sorted(map(str, plain)) == sorted(map(str, clashing)) and plain
    if name in ("op3", "op5", "op8", "op10", "op13"):  # a row for each row, repeated ones too, with equal results
        seven = [str(r) for r in plain if str(r).startswith("(7, ")]
        assert len(plain) == len(rows) and len(seven) == 3 and len(set(seven)) <= 2


def test_other_columns_pass_through(spark, model):
    docs = given(spark, TEXTS, "doc_id long, text string", True)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 1 and kept.where("doc_id = 8").first()["x y"] == "x y-8"
    pages = given(spark, [(1, "u", "<p>some text</p>"), (1, "u", "<p>some text</p>"), (2, "u", None)], "page_id long, url string, html string", True)
    got = html_extract.extract_text(pages)
    assert [(r["page_id"], r["text"], r["label"]) for r in got.orderBy("label").collect()] == [(1, "some text", "label-0"), (1, "some text", "label-1"), (2, "", "label-2")]


def test_html_of_great_length_and_ties():
    long = "<p>one sentence of a long article goes here</p>" * 30_000
    assert html_extract.main_text(f"<body><nav>menu</nav><article>{long}</article></body>").count("\n") == 29_999
    assert html_extract.main_text("<div>" * 5_000 + "deep text" + "</div>" * 5_000) == "deep text"
    twin = "<div><p>two equal blocks of text stand side by side here</p></div>"
    assert html_extract.main_text(f"<body>{twin}{twin}</body>") == "\n".join(["two equal blocks of text stand side by side here"] * 2)
    assert html_extract.main_text("<p>not <b>closed <i>well</p><p>next</b> one") == "not closed well\nnext one"
