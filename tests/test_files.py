import json
import uuid

import pytest
from pyspark.sql import functions as F

from askalot.operators import instances
from askalot.operators import testsets as tst
from askalot.plans import survey_queries
from askalot.operators import codebook, profiles, respondents, similarity
from askalot.sources import files, star_survey, surveys
from askalot.streaming import instances as streams


def test_survey_files_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Q1\n01,1.0\n02,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,Q2\n03,x\n", encoding="utf-8")
    rows = files.read_survey_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("id").collect()
    assert [(r["id"], r["Q1"], r["Q2"], r["_source_file"]) for r in rows] == [("01", "1.0", None, "a.csv"), ("02", None, None, "a.csv"), ("03", None, "x", "b.csv")]


def test_codebook_keeps_order_and_survives_values_that_are_no_object(spark, tmp_path):
    book = {"z": {"Q2": {"question": "Two?", "description": "", "values": {"2": "No", "1": "Ja, früh"}}, "Q1": {"question": "One?", "values": "String variable"}}, "EXCLUDED": {"ID": {"question": "Id?"}}}
    (tmp_path / "book.json").write_text(json.dumps(book), encoding="utf-8")
    variables, values = files.load_codebook(spark, str(tmp_path / "book.json"))
    got = [(r["section"], r["code"], r["has_values"], r["sampleable"]) for r in variables.orderBy("section_pos", "var_pos").collect()]
    assert got == [("z", "Q2", True, True), ("z", "Q1", False, True), ("EXCLUDED", "ID", False, False)]
    assert [(r["raw"], r["label"]) for r in values.orderBy("label_pos").collect()] == [("2", "No"), ("1", "Ja, früh")]


def test_instances_round_trip(spark, tmp_path):
    rows = survey_queries.instances(spark, "/root/testdata/sf0.001").limit(50).cache()
    files.write_jsonl(rows, str(tmp_path / "out"))
    back = files.read_instances(spark, str(tmp_path / "out"))
    key = lambda df: sorted(str(r["example_id"]) + str(r["questions"]) + str(r["options"]) for r in df.collect())
    assert key(back) == key(rows)


def test_json_line_is_ascii(spark):
    row = spark.createDataFrame([('Où "là"?', "\U0001f600 ok")], "q string, a string")
    assert row.select(instances.LINE["json"](row["q"], row["a"])).first()[0] == json.dumps({"q": 'Où "là"?', "a": "\U0001f600 ok"})


def test_encodings_are_tried_and_failing_files_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,Q1\n1,früh\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("id,Q1\n2,spät\n".encode())
    paths = [str(tmp_path / n) for n in ("a.csv", "none.csv", "b.csv")]
    rows = files.read_survey_files(spark, paths, encoding=None).orderBy("id").collect()
    assert [(r["Q1"], r["_source_file"]) for r in rows] == [("früh", "a.csv"), ("spät", "b.csv")]
    with pytest.raises(ValueError):
        files.read_survey_files(spark, paths[1:2])


def test_surveys_load_from_csv_and_parquet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("wave,idno,cntry,Q1\n1, 7,AT,1\n1,8,,2\n", encoding="utf-8")
    (tmp_path / "book.json").write_text(json.dumps({"a": {"Q1": {"question": "One, please?", "values": {"1": "Yes", "2": "No"}}, "Q9": {"question": "Nine, please?"}}}), encoding="utf-8")
    one = surveys.SurveyConfig("csv", (str(tmp_path / "s.csv"),), str(tmp_path / "book.json"), ("wave", "idno"), "cntry")
    s = surveys.load_survey(spark, one)
    s.wide.write.parquet(str(tmp_path / "p"))
    two = surveys.SurveyConfig("parquet", (str(tmp_path / "p"),), str(tmp_path / "book.json"), ("respondent_id",), "country", "parquet")
    lost = surveys.SurveyConfig("lost", (str(tmp_path / "p"),), str(tmp_path / "book.json"), ("nothing",), None, "parquet")
    found = surveys.load_all(spark, [one, lost, two])
    rows = surveys.long_responses(found).orderBy("survey", "respondent_id").collect()
    assert [tuple(r) for r in rows] == [(n, i, c, "Q1", v) for n in ("csv", "parquet") for i, c, v in (("1_7", "AT", "1"), ("1_8", None, "2"))]
    with pytest.raises(ValueError):
        surveys.load_all(spark, [lost], skip_errors=False)


def test_test_sets_are_written_and_read_back_typed(spark, tmp_path):
    rows = survey_queries.instances(spark, "/root/testdata/sf0.001").where("id like '%00'").cache()
    written = surveys.write_test_sets(rows, str(tmp_path), n=20, skip=("surface_form",), prefix="x_")
    assert [w.rpartition("/")[2] for w in written] == ["x_options_context", "x_feature_order"]
    want = tst.generate_options_context(rows, 20)
    back = surveys.read_test_set(spark, written[0], want)
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))
    assert spark.read.json(written[1]).select("example_id").distinct().count() <= 20


def test_json_array(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    for name, df in (("two", rows), ("none", rows.where("a > 2"))):
        files.write_json_array(df, str(tmp_path / name))
        text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / name).glob("part-*")))
        assert sorted(map(str, json.loads(text))) == sorted(str(r.asDict()) for r in df.collect())


def test_codebook_from_html(spark):
    html = """<html><body><div><h3 id="Q1">Q1 head</h3><p>How <b>often</b> ?</p> and then <p>do you go?</p>
    <div class="x data-table"><table><tr><th>c</th></tr><tr><td>1</td><td>Very <i>often</i></td></tr><tr><td> </td><td>lost</td></tr><tr><td>2</td><td>Never</td><td>3</td></tr></table></div></div>
    <div><h3>no id</h3><p>text</p></div><div><h3 id="Q2">Second</h3><p>Open?</p></div></body></html>"""
    got = files.codebook_from_html(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()
    assert [tuple(r)[1:] for r in got] == [("Q1", "How - often - ?\nand then\ndo you go?", "1", "Very often", 0), ("Q1", "How - often - ?\nand then\ndo you go?", "2", "Never", 1), ("Q2", "Open?", None, None, None)]


def test_enrichment_tries_failures_once_more(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "k int, t string").repartition(1)

    def service(batch):
        if len(batch) == 5:  # the first pass
            return batch.assign(out=batch["t"].str.upper(), failed=batch["k"] % 2 == 1)
        if (batch["k"] == 5).any() and len(batch) == 1:
            raise RuntimeError("down")
        return batch.assign(out="again", failed=batch["k"] == 5)

    got = {r["k"]: (r["out"], r["failed"], r["retried"]) for r in codebook.enrich(rows, service, "out string", "k", skip=1).collect()}
    assert got == {1: ("again", False, True), 2: ("T2", False, False), 3: ("again", False, True), 4: ("T4", False, False), 5: ("again", True, True)}


def test_enrichment_by_chance_gives_each_row_once(spark, tmp_path):
    """A service that fails at random, and writes each call down: every key once, calls as many as rows and retries, failures a row's own."""
    import random

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, "none")], "k int, t string").repartition(5)
    calls = tmp_path / "calls"
    calls.mkdir()

    def service(batch):
        k = batch["k"].iloc[0]
        (calls / f"{random.getrandbits(60)}-{k}").touch()
        if random.random() < 0.5:
            raise RuntimeError("down")
        return batch.assign(out=batch["t"].str.upper(), failed=random.random() < 0.2)

    log = str(tmp_path / "log")
    got = codebook.enrich(rows, service, "out string", "k", attempts=3, batch_rows=1, parts=2, log=log)
    for done in (got.collect(), got.collect()):
        assert len(done) == 301 and {r["k"] for r in done} == {None, *range(300)}
        assert all((r["out"] == r["t"].upper() and r["error"] is None) if not r["failed"] else r["attempt"] == 3 for r in done)
        assert sum(r["attempt"] for r in done) == len(list(calls.iterdir())) == spark.read.parquet(log).count()
        assert any(r["failed"] and "down" in (r["error"] or "") for r in done) and 0 < sum(r["retried"] for r in done) < 301
    again = codebook.enrich(rows.unionByName(spark.createDataFrame([(900, "new")], "k int, t string")), service, "out string", "k", attempts=3, batch_rows=1, log=log)
    new = [r["attempt"] for r in again.collect() if r["k"] == 900]
    assert len(new) == 1 and len(list(calls.iterdir())) == sum(r["attempt"] for r in done) + new[0]


def test_enrichment_of_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(40)], "k int").repartition(1)

    def service(batch):
        if (batch["k"] == 7).any():
            raise ValueError("seven")
        return batch.assign(out=batch["k"] * 2, failed=False)

    got = {r["k"]: (r["out"], r["failed"], r["attempt"]) for r in codebook.enrich(rows, service, "out long", "k", batch_rows=10).collect()}
    assert got == {k: (None, True, 2) if k == 7 else (2 * k, False, 1) for k in range(40)}
    assert codebook.enrich(rows.limit(0), service, "out long", "k").count() == 0


def test_enrichment_keeps_its_log_from_the_driver(spark, tmp_path):
    """Rows and log meet without a broadcast; rows are made for the first attempt, for what it left over and for the result, not for each attempt; a log is gone on with."""
    made, calls, log = tmp_path / "made", tmp_path / "calls", str(tmp_path / "log")
    made.mkdir()
    calls.mkdir()
    needs_calls = {7: 4, 11: 6, 12: 99, -1: 3}

    def note(batches):
        (made / uuid.uuid4().hex).touch()
        yield from batches

    def service(batch):
        k = int(batch["k"].fillna(-1).iloc[0])
        assert list(batch.columns) == ["k", "nothing"] and batch["nothing"].isna().all()
        (calls / f"{k}-{uuid.uuid4().hex}").touch()
        return batch.assign(out=k * 2, failed=len(list(calls.glob(f"{k}-*"))) < needs_calls.get(k, 1))

    rows = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "k int").repartition(1).mapInPandas(note, "k int").withColumn("nothing", F.lit(None))
    size = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        first = codebook.enrich(rows, service, "out int", "k", attempts=5, batch_rows=1, log=log)
        got = {r["k"]: (r["out"], r["failed"], r["attempt"]) for r in first.collect()}
        n_made = len(list(made.iterdir()))
        more = codebook.enrich(rows.where("k <> 39 or k is null").unionByName(rows.where("k = 39").withColumn("k", F.lit(90))), service, "out int", "k", attempts=7, batch_rows=1, log=log)
        again = {r["k"]: (r["out"], r["failed"], r["attempt"]) for r in more.collect()}
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", size)
    want = {k: (2 * k, False, 1) for k in range(40)} | {7: (14, False, 4), 11: (22, True, 5), 12: (24, True, 5), None: (-2, False, 3)}
    assert got == want and n_made <= 4
    del want[39]
    assert again == want | {90: (180, False, 1), 11: (22, False, 6), 12: (24, True, 7)}
    assert len(list(calls.iterdir())) == spark.read.parquet(log).count() == sum(x[2] for x in again.values()) + 1


def test_a_text_has_what_its_patterns_need(spark):
    """Each pattern finds the same with and without the literals asked for first."""
    import re

    from askalot.functions.artifact_patterns import PATTERNS
    from askalot.functions.matching import needs

    assert needs(r"\[?\s*[Ii]nterviewer\s*x+").clauses == [["interviewer"], ["x"]] and needs("^9[0-9]$").most == 4
    assert needs("(ab|c)d?").clauses == [["ab", "c"]] and needs("a*|b").clauses == [] and needs("(?:ab)*c?").clauses == [] and needs("^.{1,10}$").most == 12
    texts = ["SHOWCARD 3", "(ShowCard)", "Party A, or", "party b", "97", "97\n", "ST. STGBS.", "DK/NA", "code 5: x", "Q12", "___", "( )", "interviewer's number", "[Name of President of x]", "SA SWA SWD SD", "1.2. x", "(3-4)", "short", ""]
    texts += ["first most important, second most important", "it is 3a. and q4b", "Don’t know", "\u0130nterviewer", "x" * 5000 + " recode of"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, text string")
    got = sorted((r["k"], r["type"], r["pattern_name"], r["matched"]) for r in codebook.find_artifacts(rows).collect())
    want = sorted((k, t, n, m.group()) for k, text in enumerate(texts) for t, n, p in PATTERNS for m in re.finditer(p, text, re.IGNORECASE | re.ASCII))
    assert got == want and len(got) > 40


def test_shapes_of_codebook_files(spark, tmp_path):
    rows = [("a", '{"s":{"Q1":{"question":"How often do you?","description":"d","values":{"1":"x"}},"Q2":3},"t":"no"}'), ("b", None), ("c", "[1]"), ("d", "{}"), ("e", '{"s":{"Q1":{"question":null,"description":"d","values":[1]},"Q1":{}}}')]
    got = {(r["survey"], r["section"], r["code"], r["problem"]) for r in codebook.file_structure(spark.createDataFrame(rows, "survey string, text string")).collect()}
    assert got == {("a", "s", "Q2", "variable_not_object"), ("a", "t", None, "section_not_object"), ("b", None, None, "file_not_object"), ("c", None, None, "file_not_object"),
        ("e", "s", "Q1", "question_not_string"), ("e", "s", "Q1", "values_not_object"), ("e", None, "Q1", "duplicate_code"), *(("e", "s", "Q1", f"missing_{f}") for f in ("question", "description", "values"))}
    (tmp_path / "a.json").write_text(rows[0][1])
    variables, values = files.load_codebook(spark, str(tmp_path / "a.json"))
    assert [(r["section"], r["code"], r["has_values"]) for r in variables.collect()] == [("s", "Q1", True)] and values.count() == 1


def test_nested_json_can_be_read(spark):
    import json

    odd = 'a"b\\c\n/é'
    variables = spark.createDataFrame([("w", "s", odd, 1, odd, None), ("w", "s", odd, 2, None, odd), ("w", "s", None, 3, "x", "y")], "survey string, section string, code string, var_pos int, question string, description string")
    values = spark.createDataFrame([("w", odd, odd, "first", 0), ("w", odd, odd, odd, 1), ("w", odd, "2", None, 0)], "survey string, code string, raw string, label string, label_pos int")
    got = codebook.nested_json(variables, values).first()["variables"]
    assert json.loads(got) == {odd: {"question": None, "description": odd, "values": {"2": None, odd: odd}}}


def test_zero_vectors_are_near_nothing(spark):
    rows = spark.createDataFrame([("t", [1.0, 0.0]), ("a", [0.0, 0.0]), ("b", [2.0, 0.0])], "code string, embedding array<double>")
    scores = similarity.similarities(rows.where("code = 't'"), rows)
    assert {r["feature"]: r["similarity"] for r in scores.collect()} == {"a": None, "b": 1.0}
    assert [r["excluded"] for r in similarity.exclusions(scores).collect()] == [["b"]]


def test_a_stream_gives_the_instances_of_a_batch(spark, tmp_path):
    wide = star_survey.wide(spark, "/root/testdata/sf0.001").cache()
    wide.repartition(3).write.json(str(tmp_path / "in"))
    variables, values = star_survey.codebook(spark)
    make = lambda rows: streams.instances(rows, variables, values, star_survey.CODES, survey_queries.TARGETS, respondents.Draw(profiles.ProfileConfig(3, 2, 42)), "star")
    arriving = make(streams.respondents(spark, str(tmp_path / "in"), wide.schema.simpleString()[7:-1].replace(":", " ")))
    streams.write(arriving, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    show = lambda df: sorted(map(str, df.select("example_id", "questions", "options", "answer").collect()))
    assert show(spark.read.parquet(str(tmp_path / "out"))) == show(make(wide))
    tests = streams.option_tests(arriving).select("example_id", "option_type")
    streams.write(tests, str(tmp_path / "tests"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "tests")).count() == streams.option_tests(make(wide)).count()


def test_an_audit_runs_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "SHOWCARD 2 in [country]"), (2, None), (3, "a plain sentence of words")], "k int, text string").write.json(str(tmp_path / "in"))
    found = streams.audit(streams.respondents(spark, str(tmp_path / "in"), "k int, text string"))
    streams.write(found, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    got = {(r["k"], r["pattern_name"], r["severity"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "showcard_instruction", "warning"), (1, "country_placeholder", "critical")}


def test_files_that_break_while_they_are_read_are_named(spark, tmp_path):
    """A truncated gzip and a damaged Parquet file among good ones: left out whole, with a reason."""
    import gzip

    whole = gzip.compress("id,Q1\n".encode() + b"".join(b"%d,%d\n" % (k, k * k * 7919 % 10007) for k in range(40_000)))
    (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "good.csv.gz").write_bytes(whole)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"id,Q{k}\nx{k},1\n")
    paths = [str(tmp_path / n) for n in ("0.csv", "cut.csv.gz", "1.csv", "absent.csv", "good.csv.gz", "2.csv")]
    ledger = {}
    rows = files.read_survey_files(spark, paths, ledger=ledger)
    assert rows.count() == 40_003 and set(ledger) == {paths[1], paths[3]} and all(ledger.values())
    assert {r[0] for r in rows.select("_source_file").distinct().collect()} == {"0.csv", "1.csv", "2.csv", "good.csv.gz"}
    with pytest.raises(ValueError, match="no survey files"):
        files.read_survey_files(spark, [paths[1], paths[3]])
    with pytest.raises(Exception):
        files.read_survey_files(spark, paths[:2], skip_errors=False).collect()

    for name in ("a", "b"):
        spark.range(50_000).selectExpr("cast(id * 7919 % 10007 as string) id", "cast(rand(1) as string) Q1").coalesce(1).write.parquet(str(tmp_path / name))
    part = next((tmp_path / "a").glob("part-*.parquet"))
    data = bytearray(part.read_bytes())
    data[200 : len(data) // 2] = bytes(len(data) // 2 - 200)  # its footer stays whole
    part.write_bytes(data)
    ledger = {}
    rows = files.read_survey_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")], format="parquet", ledger=ledger)
    assert rows.count() == 50_000 and list(ledger) == [str(tmp_path / "a")]


def test_surface_form_tests_on_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = survey_queries.instances(spark, "/root/testdata/sf0.001").cache()
    rows.repartition(3).write.json(str(tmp_path / "in"))
    arriving = streams.respondents(spark, str(tmp_path / "in"), files.INSTANCE.replace("\n", " "))
    tests = streams.surface_tests(arriving)
    streams.write(tests, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    names = ["example_id", "original", "synonym", "reorder", "pronoun", "rules", "has_synonym", "has_reorder", "has_pronoun", "ground_truth_index"]
    show = lambda df: sorted(map(str, df.select(*names).collect()))
    want = show(streams.surface_tests(rows))
    assert show(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) > 100


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_features_equal_all_pairs(spark, monkeypatch, k):
    import random

    deal = random.Random(3)
    rows = [(f"c{n}", [float(deal.randint(-2, 2)) for _ in range(3)]) for n in range(60)] + [("none", None), ("short", [1.0]), ("zero", [0.0] * 3), ("hole", [1.0, None, 2.0])]
    every = spark.createDataFrame(rows, "code string, embedding array<double>").repartition(5)
    targets = every.where("code in ('c0', 'c1', 'c2', 'zero')")
    small = similarity.similarities(targets, every)
    key = lambda df: sorted((r["target"], r["feature"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in df.collect())
    near = lambda df: sorted((r["target"], r["rank"], r["feature"], r["excluded"]) for r in df.collect())
    wanted, ranked = key(small), near(similarity.nearest_features(targets, every, k, 0.5))
    scores = {(t, f): s for t, f, s in wanted if s is not None}
    plain = [(t, r, f, scores[t, f] >= 0.5) for t in ("c0", "c1", "c2") for r, f in enumerate(sorted((f for u, f in scores if u == t), key=lambda f: (-scores[t, f], f))[:k], 1)]
    assert ranked == sorted(plain) and len(wanted) == 4 * 60
    monkeypatch.setattr(similarity, "MATRIX", 2)
    assert near(similarity.nearest_features(targets, every, k, 0.5)) == ranked


def test_embedded_columns_of_any_name(spark):
    rows = spark.createDataFrame([("a b", 1, [2.0]), (None, 2, None)], "text string, `x:y,embedding int` int, embedding array<double>")
    got = similarity.embed(rows, similarity.hashed_words).collect()
    assert [sum(r["embedding"]) for r in got] == [2.0, 0.0] and [r[1] for r in got] == [1, 2]
    weighed = similarity.embed(rows).collect()
    assert [len(r["embedding"]) for r in weighed] == [64, 64] and sum(weighed[1]["embedding"]) == 0 and sum(weighed[0]["embedding"]) > 0


def test_orderings_have_reasons_and_seeds(spark):
    made = [("a", ["1", "2"], 3, ["x", "y"], "x"), ("b", None, None, ["x", "y"], "x"), ("c", [], 2, ["x", "y"], "x"), ("d", [], 3, ["x"], "x"), ("e", [], 6, ["x", "y"], "z"), ("f", [], 6, None, "x"), ("g", [], 6, ["x", "y"], "y"), ("h", [], 6, ["x", "y"], None)]
    rows = spark.createDataFrame([(i, "s", None if n is None else [f"q{k}" for k in range(n)], o, a) for i, _, n, o, a in made], "example_id string, survey string, q array<string>, options array<string>, answer string")
    got = tst.feature_orderings(rows, rows["q"], ineligible=True).collect()
    reasons = {r["example_id"]: r["reason"] for r in got}
    assert reasons == {"a": None, "b": "questions_not_dict", "c": "insufficient_features_2", "d": "insufficient_options", "e": "ground_truth_not_in_options", "f": "insufficient_options", "g": None, "h": "ground_truth_not_in_options"}
    assert sorted(r["name"] for r in got if r["example_id"] == "g") == ["original", "random_1", "random_2", "random_3", "reversed"]
    assert all((r["seed"] is None) == (r["name"] in (None, "original", "reversed")) for r in got)
    again = tst.feature_orderings(rows, rows["q"]).where("seed is not null").join(rows.select("example_id", "q"), "example_id")
    assert again.where(tst.ordering_by_seed(again["q"], again["seed"]) != again["ordering"]).count() == 0 and again.count() == 5


def test_shared_keywords_are_counted_by_lists_of_words(spark):
    """Equal to all pairs of words, also for a code with several texts; words meet in a join of distinct lists, so pairs of rows are not grouped."""
    from collections import Counter

    from askalot.operators import similarity

    texts = [(f"t{i}", "Would you trust makers, of large things?") for i in range(3)] + [("t0", "trust Parties?"), ("t9", "a b"), ("t8", None), (None, "trust makers")]
    own = [(f"f{i}", "trust the makers ????? of parties") for i in range(20)] + [("f1", "MAKERS trust"), ("f1", "MAKERS trust"), ("f2", "?????"), ("f3", None), ("t1", "trust makers"), (None, "trust makers")]
    targets, features = spark.createDataFrame(texts, "code string, text string"), spark.createDataFrame(own, "code string, text string")
    words = lambda t: {w.strip("?.,!") for w in (t or "").lower().split() if len(w) > 4}
    want = Counter((a, b) for a, x in texts for b, y in own if b not in {c for c, _ in texts if c} for w in words(x) for _ in words(y) & {w})
    found = similarity.keyword_leakage(targets, features)
    assert Counter({(r["target"], r["feature"]): r["n_shared"] for r in found.collect()}) == Counter({k: n for k, n in want.items() if n >= 2})
    assert "keys=[target#" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if ", feature#" in line and "Aggregate" in line)
