import gzip
import hashlib
import zlib

import numpy as np
import pytest

from askalot.llm import ann, byte_bpe, exact_dedup, html_extract, license_scan, line_dedup, ngram_join, packing, toxicity, warc
from askalot.llm.components import connected_components

public = pytest.importorskip("public_tokenizers")
ODD_TEXTS = [None, "", " ", "a", "A", "a", "Straße ÄÖ x ✓ \U0001f600", "one two  three\tfour\nfive six seven", "x" * 20_000, "word " * 9_000, "one two  three\tfour\nfive six seven"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(ODD_TEXTS)] + [(None, "no id", None, None), (2, " ", "en", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_exact_dedup(docs, empty):
    got = {r["doc_id"]: r for r in exact_dedup.mark_duplicates(docs).collect()}
    assert exact_dedup.mark_duplicates(docs).count() == docs.count() and exact_dedup.mark_duplicates(empty).count() == 0
    assert [got[k]["keep_id"] for k in (0, 1, 3, 4, 5, 7, 10, 8)] == [1, 1, 5, 5, 5, 10, 10, 8]
    assert got[4]["group_size"] == 3 and got[5]["kept"] and not got[4]["kept"] and got[None]["kept"]
    assert got[9]["text_sha256"] == hashlib.sha256(("word " * 9_000).encode()).hexdigest()


def test_exact_dedup_goes_on_to_the_end(spark):
    long = "y" * 9_000
    rows = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + "A")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.mark_duplicates(rows).collect()} == {1: 3, 2: 2, 3: 3}


def test_line_dedup(spark, docs, empty):
    rows = spark.createDataFrame([(k, f"own {k}\n menu \n", f"s{k}") for k in range(12)] + [(99, None, "s1"), (None, "menu", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate_lines(rows).collect()}
    assert got[3]["text"] == "own 3\n" and got[3]["n_removed"] == 1 and got[3]["n_lines"] == 2
    assert got[99]["text"] is None and got[None]["text"] == "" and len(got) == 14
    assert line_dedup.drop_boilerplate_lines(rows.limit(9)).agg({"n_removed": "sum"}).first()[0] == 0
    assert line_dedup.drop_boilerplate_lines(docs).count() == docs.count() and line_dedup.drop_boilerplate_lines(empty).count() == 0


def test_pipeline_keeps_one_copy_of_a_document_on_many_sources(spark):
    import corpus_pipeline

    text = "first line\nsecond line\n\nfirst line"
    rows = [(k, text, "en", f"s{k}", 0) for k in range(20, 32)] + [(k, f"own {k}\nmenu", "en", f"s{k}", 0) for k in range(1, 14)]
    rows += [(None, "no id\nmenu", "en", "s1", 0)] + [(None, "only there", "en", f"s{k}", 0) for k in range(12)] + [(20, text, "en", "s20", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, "").collect()
    by = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and [r["text"] for r in got if r["doc_id"] == 20] == [text] * 2 and by[21].strip() == ""
    assert by[1] == "own 1\nmenu" and by[2] == "own 2" and {r["text"] for r in got if r["doc_id"] is None} == {"no id", "only there"}


def test_license_scan(spark, docs, empty):
    rows = spark.createDataFrame([("Hello. Released under the MIT License.\nAll rights reserved",), ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",), (None,)], "text string")
    got = [[x["rule"] for x in r["license_rules"]] for r in license_scan.scan_licenses(rows).collect()]
    assert got == [["mit_notice", "all_rights"], ["apache_short_header"], []]
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(empty).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Copyright (c) 2020, Some One.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
MPL = """   This Source Code Form is subject to the terms of the Mozilla Public
   License, v. 2.0. If a copy of the MPL was not distributed with this
   file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_license_scan_of_official_texts(spark):
    comment = lambda s: "/*\n" + "\n".join(f" * {x.strip()}".rstrip() for x in s.split("\n")) + "\n */\nint main;"
    texts = [MIT, BSD, APACHE, GPL, MPL]
    want = [["mit_full", "mit_title"], ["bsd3_full", "all_rights"], ["apache_header"], ["gpl3_header"], ["mpl_notice"]]
    for form in (str, comment, lambda s: s.replace("\n", "\r\n"), lambda s: "Word.\n" + "\n\n".join(" ".join(p.split()) for p in s.split("\n\n"))):
        rows = spark.createDataFrame([(form(t),) for t in texts], "text string")
        assert [[x["rule"] for x in r["license_rules"]] for r in license_scan.scan_licenses(rows).collect()] == want
    other = ["released under the\n\nMIT license at", "not released under the MIT license at all", "." * 200_000 + " license", "all rights reserved\x01\x02", "a | all rights reserved"]
    rows = spark.createDataFrame([(t,) for t in other], "text string")
    assert [list(r["license_sentences"]) for r in license_scan.scan_licenses(rows).collect()] == [[], [], [], ["all_rights"], []]


def licences(spark, *texts):
    rows = license_scan.scan_licenses(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")).orderBy("k").collect()
    return [[x["licence"] for x in r["license_rules"]] for r in rows]


def test_license_scan_bsd_clause_with_any_name(spark):
    named = [BSD.replace("the copyright holder", n) for n in ("the University", "Some One, Inc.\n   and others", "the <organization>")]
    author = BSD.replace("Neither the name of the copyright holder nor the names of its\n   contributors may be used", "The name of the author may not be used")
    odd = BSD.replace("may be used to endorse", "shall in no case endorse")
    two = BSD[: BSD.index("3. Neither")]
    assert licences(spark, *named, author, odd, two) == [["BSD-3-Clause", "Proprietary"]] * 4 + [["BSD", "Proprietary"], ["BSD-2-Clause", "Proprietary"]]


def test_license_scan_notices_and_tags(spark):
    gpl2 = GPL.replace("either version 3", "either version 2")
    lgpl = GPL.replace("This program is free", "This library is free").replace("GNU General Public License as", "GNU Lesser General Public License as").replace("version 3", "version 2.1")
    agpl = GPL.replace("GNU General Public License as", "GNU Affero General Public License as")
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    tags = ["# SPDX-License-Identifier: Apache-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "/* SPDX-License-Identifier: MIT */", "SPDX-License-Identifier: Unknown-1.0"]
    lines = ["This project is licensed under the MIT License - see the LICENSE file for details.", "This is free and unencumbered software released into the public domain.", "Released under the BSD 3-Clause License", "Distributed under the terms of the Mozilla Public License, version 2.0."]
    want = [["GPL-2.0-or-later"], ["LGPL-2.1-or-later"], ["AGPL-3.0-or-later"], ["ISC"], ["Apache-2.0"], ["GPL-2.0-or-later"], ["MIT"], [], ["MIT"], ["Unlicense"], ["BSD-3-Clause"], ["MPL-2.0"]]
    assert licences(spark, gpl2, lgpl, agpl, isc, *tags, *lines) == want


def test_license_scan_equals_its_sql(spark):
    import duckdb
    import pandas as pd

    comment = lambda s: "/*\n" + "\n".join(f" * {x.strip()}".rstrip() for x in s.split("\n")) + "\n */\nint main;"
    texts = [None, "", "licence " * 9_000, "a. all rights reserved", "The MIT license. The MIT License. permission\n\n\nMIT License", "(c) ... all rights reserved ...", "1. MIT license\nb) Apache License,\nVersion 2.0\n"]
    texts += [f(t) for t in (MIT, BSD, BSD.replace("the copyright holder", "the University"), BSD.replace("may be used", "x"), APACHE, GPL, MPL) for f in (str, comment, lambda s: s.replace("\n", "\r\n"), lambda s: " ".join(s.split()), lambda s: s + "\n" + s)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(license_scan.oracle()).fetchall()
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = [(r["doc_id"], len(r["license_sentences"]), ",".join(r["license_sentences"]), ",".join(x["rule"] for x in r["license_rules"]), ",".join(dict.fromkeys(x["licence"] for x in r["license_rules"]))) for r in rows]
    assert sorted(got) == sorted(want) and sum(1 for r in got if r[1]) > 30


def test_byte_bpe_equals_tiktoken(docs, empty):
    import base64

    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_documents(docs.where("doc_id is not null"), path, public.PATTERN)
    for r in encoded.collect():
        assert list(r["ids"]) == other.encode_ordinary(ODD_TEXTS[r["doc_id"]] or "")
    for r in byte_bpe.decode_documents(encoded, path, public.PATTERN).collect():
        assert bytes(r["bytes"]).decode() == (ODD_TEXTS[r["doc_id"]] or "")
    assert byte_bpe.round_trip_digests(docs, path, public.PATTERN).count() == docs.count()
    assert byte_bpe.round_trip_digests(empty, path, public.PATTERN).count() == 0


def test_minimal_perfect_hash_is_minimal():
    keys = [str(k).encode() for k in range(5000)]
    h = byte_bpe.MinimalPerfectHash(keys)
    assert h.find(keys) == list(range(5000)) and h.find([b"x", b""]) == [-1, -1] and sorted(h.keys) == sorted(keys)


def test_packing(docs, empty):
    path = public.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs.where("doc_id is not null"), path).toPandas()
    whole = packing.tokenizer(path)
    for i, part in rows.drop_duplicates(["doc_id", "piece"]).groupby("doc_id"):
        ids = np.asarray([*whole.encode(ODD_TEXTS[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for r in part.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert part["length"].sum() == len(ids)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= packing.MAX
    assert packing.pack_documents(empty, path).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths, n = np.unique(rng.integers(1, 2049, 20_000), return_counts=True)
    plan = packing.make_plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    used = (plan["sequence"] + (plan["to_rank"] - plan["from_rank"] - 1) // plan["each"]).max() + 1
    assert used <= 1.01 * (lengths * n).sum() / 2048 and (plan["to_rank"] - plan["from_rank"]).sum() == 20_000


@pytest.mark.parametrize(("low", "high", "n"), [(1, 60, 2_000_000), (100, 400, 20_000), (250, 600, 5_000), (700, 1000, 200_000), (1, 2048, 20_000)])
def test_plan_is_fitted_for_short_and_long_pieces(low, high, n):
    rng = np.random.default_rng(1)
    lengths, times = np.unique(rng.integers(low, high + 1, n), return_counts=True)
    counts = dict(zip(lengths.tolist(), times.tolist(), strict=True))
    plan = packing.make_plan(counts)
    used = (plan["sequence"] + (plan["to_rank"] - plan["from_rank"] - 1) // plan["each"]).max() + 1
    assert (plan["to_rank"] - plan["from_rank"]).sum() == n and used <= 1.01 * packing.best_fit(counts, 2048, 0)[1]
    filled = np.zeros(used, dtype=int)
    for r in plan.itertuples():
        k = np.arange(r.to_rank - r.from_rank)
        np.add.at(filled, r.sequence + k // r.each, r.length)
    assert filled.max() <= 2048 and filled.min() > 0
    assert packing.fitted_share(counts) >= 0.5  # of the pieces, those in fitted patterns


def test_warc(spark, tmp_path):
    big = "<p>" + "z" * 1500 + "</p>"
    rows = [(1, "u1", big), (2, None, big), (3, "u3", None), (4, "u4", "short"), (5, "u5", "short"), (None, "u6", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = {r["record_id"]: r for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert len(got) == 6 and got["urn:page:1"]["record_type"] == "revisit" and got["urn:page:1"]["refers_to"] == "urn:page:2" and got["urn:page:1"]["payload_bytes"] == len(big)
    assert bytes(got["urn:page:2"]["payload"]).decode() == big and got["urn:page:5"]["record_type"] == "response"
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert b"".join(gzip.decompress(f) for f in files if f).count(b"WARC/1.1\r\n") == 6


def test_warc_with_magics_inside_members_and_small_ranges(spark, tmp_path):
    rng, data, texts = np.random.default_rng(1), b"", {}
    for k in range(40):
        body = b"".join(rng.bytes(37) + warc.MAGIC for _ in range(30))
        z = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the magics stay
        data += z.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n") + z.flush()
        texts[f"urn:page:{k}"] = body
    (tmp_path / "one.warc").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "one.warc")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == texts


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four</article><div class='comments'><p>a long reader comment here</p></div><footer>f</footer>"
    assert html_extract.main_text(page) == "A & B\none two\nthree four"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<nav>x</nav>"), (5, "u", "plain < text")], "page_id long, url string, html string")
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_text(rows).collect()}[5] == ("plain < text", 12)
    assert html_extract.extract_text(rows.limit(0)).count() == 0


BODY = "".join(f"<p>Paragraph {k} of the article tells at some length what happened there.</p>" for k in range(6))
TEXT = "\n".join(f"Paragraph {k} of the article tells at some length what happened there." for k in range(6))


@pytest.mark.parametrize(
    "open_, close",
    [
        ('<div id="page" class="site"><div class="site-content">', "</div></div>"),
        ('<div class="layout has-sidebar">', "</div>"),
        ('<main class="with-sidebar">', "</main>"),
        ('<main class="notice"><div class="widget"><article>', "</article></div></main>"),
        ('<article class="post category-social comments-open">', "</article>"),
        ('<span class="site">', "</span>"),
        ('<div class="social"><article class="post">', "</article></div>"),
    ],
)
def test_html_class_names_do_not_mute_the_page(open_, close):
    extra = '<div class="ad">buy this now</div><div id="comments"><p>one reader says a word about it</p></div>'
    assert html_extract.main_text(f"<body>{open_}{BODY}{close}{extra}</body>") == TEXT
    thread = '<div id="comments"><article>one reader says a word about it</article></div>'
    assert html_extract.main_text(f"<body><article>{BODY}{thread}</article>{thread}</body>") == TEXT
    line = BODY.replace("what", '<span class="share">Share it</span><b class="notices-none">what</b>')
    assert html_extract.main_text(f"<body>{open_}{line}{close}{extra}</body>") == TEXT


@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_html_density_decides_with_and_without_article_markup(tag):
    links = '<div class="list"><ul>' + "".join(f"<li><a href={k}>see page {k}</a></li>" for k in range(20)) + "</ul></div>"
    page = f"<body><div><a href=x>home</a></div><{tag}>{links}<section>{BODY}</section><h2>More</h2><div>{BODY}{BODY}</div></{tag}><div>c 2026 <a href=y>imprint</a></div></body>"
    assert html_extract.main_text(page) == "\n".join([TEXT, "More", TEXT, TEXT])


SECTIONS = f"<section><h2>One</h2>{BODY}</section><section><h2>Two</h2><p>Short one.</p></section><figure><img src=x><figcaption>Caption</figcaption></figure>"


@pytest.mark.parametrize("tag", ["article", "div", "main"])
def test_html_keeps_all_sections_of_an_article(tag):
    menu = "<div><a href=x>home</a></div>"
    assert html_extract.main_text(f"<body>{menu}<{tag}>{SECTIONS}</{tag}>{menu}</body>") == f"One\n{TEXT}\nTwo\nShort one.\nCaption"
    links = "<ul>" + "".join(f"<li><a href={k}>see page {k}</a></li>" for k in range(9)) + "</ul>"
    page = f"<body><article><h1>Title</h1><p>Lead.</p>{links}<div><div>{BODY}</div><p>By <a href=y>some one</a></p></div><h2>Last</h2><ul><li>one</li><li>two</li></ul></article></body>"
    assert html_extract.main_text(page) == f"Title\nLead.\n{TEXT}\nBy some one\nLast\none\ntwo"


@pytest.mark.parametrize("name", ["comments-area", "comment-list", "ad-slot", "related-posts", "newsletter-signup", "adSlot top", "share_buttons", "post__comments", "reader-comments", "cookie-banner"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_compound_names_are_noise(name, tag):
    noise = f'<div class="{name}"><p>Something that is no part of what the article says.</p></div>'
    assert html_extract.main_text(f"<body><{tag}>{BODY}{noise}</{tag}>{noise}</body>") == TEXT


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "ad-free", "comments-open layout", "content-sidebar-wrap", "post-header-image", "with-related"])
def test_html_compound_names_do_not_mute_the_page(name):
    assert html_extract.main_text(f'<body><div class="{name}"><article>{BODY}</article></div></body>') == TEXT
    assert html_extract.main_text(f'<body><div class="{name}">{BODY}</div><p class="ad">buy</p></body>') == TEXT


def test_html_inline_elements_do_not_split_a_block():
    assert html_extract.main_text(f"<body><article>{BODY}<p>Use <label>this label</label> here, <math><mi>x</mi><mo>+</mo><mn>1</mn></math> too.</p></article></body>") == TEXT + "\nUse this label here, x+1 too."


@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_pages_equal_their_articles(spark, tag):
    """Every page of the small tables: the text of its article element, also where that is a div like any other."""
    import html
    import re

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    for page in pages:
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner.replace("<br>", " ")))
        assert html_extract.main_text(page.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == "\n".join(b for b in blocks if b)


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 16)), np.ones((500, 16))])
    bad = [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0]), (None, [1.0] * 16)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<double>")
    got = ann.search(rows, lambda i: i % 100 == 0).toPandas()
    hit = 0
    for q in range(0, 3500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["score"].tolist() == pytest.approx([d[i] for i in own["vec_id"]], rel=1e-12)
        hit += len(set(own["vec_id"]) & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hit >= 0.9 * 350 and set(got["query_id"]) == set(range(0, 3500, 100))
    assert ann.search(rows.limit(0), lambda i: i % 100 == 0).count() == 0
    assert ann.search(rows.where("vec_id < 4"), lambda i: i % 100 == 0).count() == 3


def test_ann_with_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(600, 8)), np.zeros((1, 8))])
    x[600] = x[100] + 0.001  # next to a query, and repeated more than k times
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(600, x[600].tolist())] * 40
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).toPandas()
    hit = 0
    for q in range(0, 601, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = got[got["query_id"] == q]["vec_id"].tolist()
        assert len(own) == len(set(own)) == 10
        hit += len(set(own) & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 130


def test_ann_leaves_grow_trees_and_searches_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 400)
    monkeypatch.setattr(ann, "PART", 400)
    monkeypatch.setattr(ann, "GROW", 100)
    monkeypatch.setattr(ann, "QUERIES", 20)  # blocks that meet their queries in parts
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(30, size=6_000)] + rng.normal(size=(6_000, 12)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.search(df, lambda i: i % 100 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(found))
    assert len(got) == 60 and all(len(f) == 10 for f in got.values()) and hits >= 0.9 * 600
    tree = ann.Tree(x[:400])
    before = tree.leaves
    tree.graft({0: ann.Tree(x[tree.assign(x) == 0])})
    own = tree.assign(x)
    assert tree.leaves > before and 0 not in own and len(tree.centres) == len(tree.leaf) == len(tree.children)
    assert set(tree.best_bins(x[0])) == set(range(tree.leaves)) - {0} and tree.ranks(x[0], [int(own[0])])[0] < tree.leaves


def test_toxicity(spark, empty):
    texts = [(k, f"this {'idiot' if k % 4 == 0 else 'person'} reads book {k} about {'women' if k % 4 == 0 else 'men'}.") for k in range(400)]
    docs = spark.createDataFrame([*texts, (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(7, None), (1000, 0), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert all((model.score(t) >= 0.5) == (k % 4 == 0) for k, t in texts)
    assert abs(model.score("women read a book") - model.score("men read a book")) < 0.05
    assert toxicity.score_documents(docs, model).count() == 401 and model.score(None) == model.score("") < 0.5
    assert toxicity.train(docs, labels.limit(0)).score("idiot") == 0 and toxicity.score_documents(empty, model).count() == 0


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def test_ngram_join_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 10_000, 60)]
    texts = list(ODD_TEXTS)
    for k in range(150):  # a group of near copies, some near enough only for some
        own = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            own[at] = f"v{k}"
        texts.append(" ".join(own))
    texts += [" ".join(f"u{k}" for k in rng.integers(0, 50, 40)) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(rows).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)
    assert ngram_join.near_duplicates(docs).count() == docs.count() and ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_links_lists_that_are_dealt_to_salts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 2)  # every shingle of two documents has two salts or more
    texts = [" ".join(["same"] * (j == 1) + [f"t{k}x{w}" for w in range(40)]) for k in range(24) for j in range(2 + k % 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(rows).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (40, 50), (60, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(31)} | {40: 40, 50: 40}


def test_warc_gz_is_read_in_ranges(spark, tmp_path):
    """One .warc.gz of many members, with damaged ones and the magic inside payloads: several tasks, each record once."""
    payloads = {f"urn:{k}": (b"\x1f\x8b\x08 odd" if k % 7 == 0 else b"body ") + bytes(np.random.default_rng(k).integers(0, 256, 200 + 5 * k, dtype=np.uint8)) for k in range(150)}
    folder = tmp_path / "some where"
    folder.mkdir()
    with open(folder / "a.warc.gz", "wb") as f:
        for name, body in payloads.items():
            f.write(warc.member("response", name, None, body, hashlib.sha1(body).hexdigest(), None))
            f.write(b"\x1f\x8b\x08 no member" if name.endswith("3") else b"")
    (folder / "b.warc").write_bytes(warc.member("response", "urn:b", None, b"b", hashlib.sha1(b"b").hexdigest(), None))
    keys = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        ranges = warc.byte_ranges(spark, str(folder), "\u001f\u008b\u0008").select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        rows = warc.read_warc(spark, str(folder)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert ranges > 5 and len(rows) == 151 and {r["record_id"]: bytes(r["payload"]) for r in rows} == payloads | {"urn:b": b"b"}


def test_warc_named_gz_and_repeated_rows_and_empty_table(spark, tmp_path):
    long = "<p>" + "x" * 2000 + "</p>"
    inner = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb\r\n\r\nWARC/1.0"
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (3, None, None), (None, "u", "short"), (4, "u", inner)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("part-*"):
        f.rename(f.with_name(f.stem + ".warc.gz"))
    got = sorted((r["record_id"], r["record_type"], r["payload_bytes"], r["refers_to"] or "") for r in warc.read_warc(spark, str(tmp_path / "w" / "*.warc.gz")).collect())
    assert got == [("urn:page:", "response", 5, ""), ("urn:page:1", "revisit", len(long), "urn:page:2"), *[("urn:page:2", "response", len(long), "")] * 2, ("urn:page:3", "response", 0, ""), ("urn:page:4", "response", len(inner), "")]
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_columns_whose_names_clash_pass_through(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    extra = ["__id", "__row", "__drop", "__id2", "__place", "__line", "c0", "node", "component_id", "n", "score", "__gone"]
    rows = [(i, f"Shared line here\nown line {i} of this text", f"s{i}", *[f"{c}{i}" for c in extra]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in extra))
    got = line_dedup.drop_boilerplate_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert all(r["text"] == f"own line {r['doc_id']} of this text" and r["__id"] == f"__id{r['doc_id']}" and r["c0"] == f"c0{r['doc_id']}" and r["n_removed"] == 1 for r in got.collect())
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.ngram_join):
        assert stage(spark, docs.withColumn("n_chars", F.length("text")), "").select(*extra).count() == 12
