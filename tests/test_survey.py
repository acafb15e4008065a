import duckdb
import pytest
from pyspark.sql import functions as F

from askalot.operators import builder, country, decode, instances, profiles, respondents
from askalot.plans import ALL
from askalot.sources import star_survey

DIR = "/root/testdata/sf0.001"
CONFIG = profiles.ProfileConfig(2, 1, 42)


@pytest.fixture(scope="module")
def small(spark):
    variables = spark.createDataFrame(
        [("demo", 0, "AGE", 0, "How old are you?"), ("demo", 0, "GENDER", 1, "What is your gender?"), ("opinions", 1, "Q1", 2, "Do you feel satisfied?"), ("opinions", 1, "Q2", 3, "Do you trust the media?"), ("opinions", 1, "Q3", 4, "Do you use social media?")],
        "section string, section_pos int, code string, var_pos int, question string",
    )
    labels = {"AGE": {"1": "18-24", "2": "25-34"}, "GENDER": {"M": "Male", "F": "Female"}, "Q1": {"1": "Yes", "2": "No", "99": "Missing"}, "Q2": {"1": "High", "2": "Low"}, "Q3": {"1": "Often", "2": "Rarely"}}
    values = spark.createDataFrame([(c, raw, label, k) for c, m in labels.items() for k, (raw, label) in enumerate(m.items())], "code string, raw string, label string, label_pos int")
    wide = spark.createDataFrame([("0", "AT", "1", "M", "1", "2", "1"), ("1", "AT", "2", "F", "99", "1", "2.0")], "respondent_id string, country string, AGE string, GENDER string, Q1 string, Q2 string, Q3 string")
    return variables, values, decode.decode_answers(decode.to_long(wide, list(labels)), values)


def test_options_leave_missing_labels_out(small):
    assert {r["code"]: r["options"] for r in decode.valid_options(small[1]).collect()}["Q1"] == ["Yes", "No"]


def test_lookup_by_integer_part(small):
    assert small[2].where("respondent_id = '1' and code = 'Q3'").first()["label"] == "Rarely"


def test_target_is_no_feature_and_missing_target_gives_no_instance(small):
    rows = instances.build_instances(small[2], small[0], small[1], ["Q1"], CONFIG, "unit").collect()
    assert [(r["id"], r["answer"], r["options"]) for r in rows] == [("0", "Yes", ["Yes", "No"])]
    assert "Do you feel satisfied?" not in {q["question"] for q in rows[0]["questions"]} and len(rows[0]["questions"]) == 2


def test_profiles_nest(small):
    variables, _, decoded = small
    people = decoded.select("respondent_id").distinct()
    draw = lambda m: {(r["respondent_id"], r["code"]) for r in profiles.profiles(decoded, profiles.feature_pool(variables), people, profiles.ProfileConfig(2, m, 1)).collect()}
    assert draw(1) < draw(2)


def test_country_in_a_name(spark):
    rows = spark.createDataFrame([("edlveat", "edlve"), ("prtvgde1", "prtvg"), ("prtvclt3", "prtvc")], "code string, prefix string").collect()
    got = [spark.createDataFrame([(r["code"],)], "code string").select(country.country_of(F.col("code"), r["prefix"])).first()[0] for r in rows]
    assert got == ["AT", "DE", "LT"]


QUERIES = {name: query for module in ALL for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in ALL for name, sql in module.oracles().items()}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "lineitem", "part", "documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    rows = lambda found: sorted(str(tuple(r)) for r in found)
    assert want and rows(got.collect()) == rows(want)


def test_long_form_has_one_exchange(spark):
    wide = star_survey.wide(spark, DIR).repartition("respondent_id")
    plan = decode.to_long(wide, star_survey.CODES).groupBy("respondent_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(respondent_id") == 1


@pytest.fixture(scope="module")
def answered(spark, small):
    variables, values, _ = small
    codes = ["AGE", "GENDER", "Q1", "Q2", "Q3"]
    wide = spark.createDataFrame([("0", "AT", "1", "M", "1", "2", "1"), ("1", "AT", "2", "F", "99", "1", "2.0"), ("2", None, None, None, None, None, None)], "respondent_id string, country string, " + ", ".join(f"{c} string" for c in codes))
    return respondents.answer_rows(wide, respondents.book(variables, values, codes), codes)


def codes_of(rows, name="features"):
    return {r["respondent_id"]: [a["code"] for a in r[name]] for r in rows.collect()}


def test_both_forms_of_a_profile_are_equal(small, answered):
    variables, _, decoded = small
    long = profiles.profiles(decoded, profiles.feature_pool(variables, excluded=["Q1"]), decoded.select("respondent_id").distinct(), CONFIG)
    own = codes_of(respondents.with_profile(answered, respondents.Draw(CONFIG, ("Q1",))))
    assert {(r["respondent_id"], r["code"]) for r in long.collect()} == {(k, c) for k, v in own.items() for c in v}
    assert own["2"] == []


def test_always_included_come_first_unless_missing(answered):
    own = codes_of(respondents.with_profile(answered, respondents.Draw(CONFIG, ("AGE",), ("Q2", "Q1"))))
    assert own["0"][:2] == ["Q2", "Q1"] and own["1"][0] == "Q2" and "Q1" not in own["1"]  # of respondent 1, Q1 is missing
    assert all("AGE" not in v for v in own.values())


def test_expansion_keeps_the_profile_and_adds_to_it(answered):
    draw = respondents.Draw(profiles.ProfileConfig(1, 1, 42))
    rows = respondents.with_expanded(respondents.with_profile(answered, draw), draw, 1, 1).where("respondent_id = '0'").first()
    old, new = [a["code"] for a in rows["features"]], [a["code"] for a in rows["expanded"]]
    assert new[:1] == old and len(new) == len(set(new)) == 4  # one more of the old section, two of the new one


def test_draws_that_cannot_be_satisfied_are_errors(small):
    variables, draw = small[0], respondents.Draw
    assert respondents.check_draw(variables, draw(CONFIG, ("NOPE",))) == {"unknown_exclusions": ["NOPE"]}
    for bad in (draw(profiles.ProfileConfig(3, 1, 1)), draw(profiles.ProfileConfig(2, 3, 1)), draw(CONFIG, ("AGE",), ("AGE",)), draw(CONFIG, (), ("NOPE",))):
        with pytest.raises(ValueError):
            respondents.check_draw(variables, bad)


def test_exclusions_are_replaced_or_joined():
    draw = respondents.Draw(CONFIG, ("A",))
    assert draw.exclude(["B"]).excluded == ("A", "B") and draw.exclude(["B"], add=False).excluded == ("B",)


def test_target_labels_need_whole_numbers(spark, small):
    variables, values, _ = small
    wide = spark.createDataFrame([("0", "AT", "1.0", "1")], "respondent_id string, country string, Q1 string, Q3 string")
    rows = respondents.answer_rows(wide, respondents.book(variables, values, ["Q1", "Q3"]), ["Q1", "Q3"])
    got = respondents.instances(rows, ["Q1"], respondents.Draw(profiles.ProfileConfig(1, 1, 1)), "unit").first()
    assert got["answer"] == "1.0" and got["options"] == ["Yes", "No", "1.0"]
    assert rows.first()["answers"][0]["label"] == "Yes"


def test_an_empty_list_of_country_options_stays_empty(spark, answered):
    options = spark.createDataFrame([("AT", "Q1", [])], "country string, code string, options array<string>")
    got = respondents.instances(answered, ["Q1"], respondents.Draw(CONFIG), "", country_options=options).first()
    assert got["options"] == ["Yes"] and got["base_id"] == "0_Q1"


def test_row_local_plan_has_one_scan_of_the_survey_and_no_exchange(spark, small):
    variables, values, _ = small
    wide = spark.read.parquet(f"{DIR}/orders.parquet").selectExpr("cast(o_orderkey as string) respondent_id", "o_orderstatus country", "o_orderpriority AGE", "o_orderstatus Q1")
    rows = respondents.answer_rows(wide, respondents.book(variables, values, ["AGE", "Q1"]), ["AGE", "Q1"])
    plan = respondents.instances(rows, ["Q1"], respondents.Draw(CONFIG), "x")._jdf.queryExecution().executedPlan().toString()
    survey = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in survey and plan.count("FileScan parquet") == 1
    # Sections and features are drawn once, also where targets have exclusions of their own or are concepts.
    excluded = spark.createDataFrame([("Q1", ["AGE"])], "target_code string, excluded array<string>")
    concepts = spark.createDataFrame([("c", "O", "Q1", 0)], "concept string, country string, code string, pos int")
    draws = lambda df: df._jdf.queryExecution().executedPlan().toString().count("md5(")
    own = respondents.Draw(CONFIG)
    assert plan.count("md5(") == draws(respondents.instances(rows, ["Q1"], own, "x", exclusions=excluded)) == draws(builder.concept_instances(rows, concepts, own, "x")) == 2


def test_a_given_list_of_country_questions_takes_the_place_of_detection(spark, small, caplog):
    variables, values, _ = small
    codes = ["AGE", "GENDER", "Q1", "Q2", "Q3"]
    people = [(str(k), "AT" if k < 4 else "BE", "1", "M", "1" if k < 4 else "2", "12"[k % 2], "1") for k in range(8)]
    wide = spark.createDataFrame(people, "respondent_id string, country string, " + ", ".join(f"{c} string" for c in codes))
    build = lambda table, **how: builder.build_survey_dataset(builder.Survey("s", table, variables, values, codes), respondents.Draw(profiles.ProfileConfig(1, 1, 1)), 5, 8, **how)
    options = lambda rows: {(r["target_code"], r["country"]): r["options"] for r in rows.collect()}
    variables = variables.unionByName(spark.createDataFrame([("more", 2, "X", 5, "Another one?")], variables.schema))
    wide = wide.withColumn("X", F.lit("1"))
    codes = [*codes, "X"]
    listed = options(build(wide, country_codes=["Q1", "NONE"]))
    assert listed["Q1", "AT"] == ["Yes"] and listed["Q1", "BE"] == ["No"] and listed["Q2", "AT"] == ["High", "Low"] and "NONE" in caplog.text
    assert options(build(wide, country_codes=[]))["Q1", "AT"] == ["Yes", "No"]
    nowhere = wide.withColumn("country", F.lit(None).cast("string"))
    assert options(build(nowhere, country_codes=["Q1"]))["Q1", None] == ["Yes", "No"] and "no countries" in caplog.text


def test_failing_surveys_are_left_out(spark, small):
    variables, values, _ = small
    codes = ["AGE", "GENDER", "Q1", "Q2", "Q3"]
    wide = spark.createDataFrame([("0", "AT", "1", "M", "1", "2", "1")], "respondent_id string, country string, " + ", ".join(f"{c} string" for c in codes))
    good = builder.Survey("good", wide, variables, values, codes)
    bad = builder.Survey("bad", wide.drop("Q1"), variables, values, codes)
    rows, failed = builder.build_dataset([bad, good], respondents.Draw(profiles.ProfileConfig(1, 1, 1)), 2, 5)
    assert failed == ["bad"] and {r["survey"] for r in rows.collect()} == {"good"}


def test_many_surveys_are_one_plan_and_equal_each_alone(spark, small):
    """Surveys of different columns, targets and countries: the plan of all gives what each gives alone; drawing stands in it once."""
    variables, values, _ = small
    codes = ["AGE", "GENDER", "Q1", "Q2", "Q3"]
    made = []
    for n in range(12):
        own = codes[n % 2 :] + ([f"X{n}"] if n % 3 else [])
        people = [(str(k), ("AT", "BE", None)[(k + n) % 3], *["12"[(k + n + j) % 2] for j in range(len(own))]) for k in range(7)]
        wide = spark.createDataFrame(people, "respondent_id string, country string, " + ", ".join(f"{c} string" for c in own))
        made.append(builder.Survey(f"s{n}", wide, variables.where(F.col("code") != codes[n % 4]), values, own))
    draw = respondents.Draw(profiles.ProfileConfig(2, 1, 7))
    show = lambda df: sorted(map(str, df.collect()))
    every, failed = builder.build_dataset(made, draw, 2, 4)
    rows = show(every)
    for s in made[:4]:
        alone = show(builder.build_survey_dataset(s, draw, 2, 4))
        assert alone == [r for r in rows if f"survey='{s.name}'" in r] and alone
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    few = builder.build_dataset(made[:2], draw, 2, 4)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not failed and plan.count("md5(") == few.count("md5(")
    # What follows the two passes reads their stored results: neither surveys nor exchanges of them are in the plan again.
    survey = spark.read.parquet(f"{DIR}/orders.parquet").selectExpr("cast(o_orderkey % 4000 as string) respondent_id", "cast(o_custkey % 3 as string) country", "'1' AGE", "'M' GENDER", "cast(o_orderkey % 2 + 1 as string) Q1", "'2' Q2", "'1' Q3")
    big, _ = builder.build_dataset([builder.Survey("big", survey, variables, values, codes)], draw, 2, 4)
    assert "orders.parquet" not in big._jdf.queryExecution().optimizedPlan().toString() + "".join(big.inputFiles()) and big.select("id").distinct().count() == 4
    with pytest.raises(ValueError, match="by name"):
        builder.build_dataset([made[0], made[0]], draw, 2, 4)
    assert builder.build_dataset([], draw, 2, 4) == (None, [])


def test_lists_are_remembered_without_dealing_rows_by_them(spark, monkeypatch):
    """Values that aren't remembered are worked on in their rows, with the same result; rows are not dealt by list."""
    from askalot.functions import binding
    from askalot.operators import testsets, variations

    lists = [["Strongly agree", "Agree", "Refused"], ["Yes", "No"], ["Very good", "Good", "Bad"], None, ["Don't know"]]
    rows = spark.createDataFrame([(f"e{k}", "What do you think?", lists[k % 5], "Agree") for k in range(40)], "example_id string, target_question string, options array<string>, answer string").repartition(4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for operator in (testsets.options_context, variations.surface_forms):
        found = []
        for memo in (2_000, 1):
            monkeypatch.setattr(binding, "MEMO", memo)
            out = operator(rows)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size isn't known to be small
            try:
                assert "SortMergeJoin" not in plan(out)
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            out = operator(rows)
            found.append(sorted(map(str, out.collect())))
        assert found[0] == found[1] and len(found[0]) == (40 if operator is testsets.options_context else 32)


def test_integer_keys_of_odd_answers(spark):
    odd = {"1.0": "1", "1.7": "1", " 2.5 ": "2", "+3": "3", "-3.9": "-3", ".5": "0", "1e3": "1000", "BUILDING": None, "": None, "NaN": None, "Infinity": None, "-Infinity": None, "1-2": None}
    rows = spark.createDataFrame([(k,) for k in odd], "raw string").select("raw", decode.integer_key(F.col("raw")).alias("key"))
    assert {r["raw"]: r["key"] for r in rows.collect()} == odd


def test_seeds_make_orderings_again_in_one_pass(spark):
    """The instances are made once, not joined with themselves."""
    plan = QUERIES["ord_1_seeds"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == QUERIES["ins_1_instances"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_listed_profiles_are_drawn_once(spark):
    from askalot.plans import respondent_queries

    plan = respondent_queries.prf_7_always_include(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 2


def test_integers_as_written(spark):
    raws = ["1", " +1", "-2", "1.0", "x", "", "1e3", "7\n", "12x", "9999999999999999999", None]
    rows = spark.createDataFrame([(x,) for x in raws], "raw string").select(decode.written_integer(F.col("raw")).alias("k"), F.col("raw").try_cast("long").cast("string").alias("want")).collect()
    assert [r["k"] for r in rows] == [r["want"] for r in rows]


def test_long_form_is_dealt_by_the_size_of_the_input(spark):
    from askalot.plans import survey_queries
    from askalot.sources.splits import TIMES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        plan = survey_queries.prf_11_shortfall(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert f", {TIMES}), REPARTITION_BY_NUM" in plan


def _optimized(spark, name):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_accuracy_makes_the_instances_once(spark):
    """Predictions bring what they are held against, and only the first ordering is made. The join gives the same for predictions from elsewhere."""
    from askalot.operators import evaluation

    plan, base = _optimized(spark, "evl_1_accuracy"), _optimized(spark, "ins_1_instances")
    assert plan.count("Join") == base.count("Join") and plan.count("md5(") == base.count("md5(")
    rows = spark.createDataFrame([("a", "x", "t", "x"), ("b", "x", "t", "y"), ("c", "z", "u", "z")], "example_id string, prediction string, target_code string, answer string")
    assert sorted(evaluation.accuracy(rows).collect()) == sorted(evaluation.accuracy(rows.select("example_id", "prediction"), rows.drop("prediction")).collect())


def test_instances_of_raw_answers_equal_those_of_decoded_ones(spark, small):
    variables, values, _ = small
    codes = ["AGE", "GENDER", "Q1", "Q2", "Q3"]
    people = [(str(k), "AT", ["1", "1.0", " +1", None, "x"][k % 5], "MF?"[k % 3], ["1", "99", "1.7", None][k % 4], ["1", None, "Refused"][k % 3], ["2", "2.0", ""][k % 3]) for k in range(60)] + [("none", None, None, None, None, None, None)]
    wide = spark.createDataFrame(people, "respondent_id string, country string, " + ", ".join(f"{c} string" for c in codes))
    variables = variables.unionByName(spark.createDataFrame([("opinions", 1, "Q4", 5, "Do you trust the media?")], variables.schema))  # a question text that occurs twice
    wide, codes, book = wide.withColumn("Q4", F.col("Q3")), [*codes, "Q4"], respondents.book(variables, values, [*codes, "Q4"])
    for draw in (respondents.Draw(profiles.ProfileConfig(2, 2, 7)), respondents.Draw(profiles.ProfileConfig(2, 3, 1), ("AGE",)), respondents.Draw(CONFIG, (), ("Q2",))):
        got = respondents.direct_instances(wide, book, codes, ["Q1", "Q3"], draw, "s")
        want = respondents.instances(respondents.answer_rows(wide, book, codes), ["Q1", "Q3"], draw, "s")
        assert want.count() > 50 and sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_statistics_of_orderings_make_none(spark):
    from askalot.operators import testsets

    plan, base = _optimized(spark, "ord_4_statistics"), _optimized(spark, "ins_1_instances")
    assert plan.count("Join") == base.count("Join") and plan.count("md5(") == base.count("md5(")
    rows = spark.createDataFrame([("e", ["x"], "x", ["a", "b"])], "example_id string, options array<string>, answer string, q array<string>")
    got = testsets.ordering_statistics(testsets.with_orderings(rows, rows["q"])).collect()
    assert sorted(map(tuple, got)) == [("eligible", "all", 0), ("orderings", "all", 0), ("processed", "all", 1)]  # as SQL counts where nothing is eligible


def test_a_sample_by_size_reads_what_it_is_drawn_from_once(spark):
    """The instances are stored for the counts and the sample, not made for each."""
    assert "md5(concat_ws(|, 42, respondent_id" not in _optimized(spark, "smp_4_by_size")


def test_windows_of_lists_of_any_length(spark):
    """Short lists are ordered by compiled code, long ones by functions over arrays; both as the SQL does."""
    from hashlib import md5

    from askalot.operators import testsets

    lists = {f"e{n}-{k}": [f"q{(j * 7 + k) % 5}=é{'a' * (j % 3)}" if k else f"q{j}=a" for j in range(n)] for n in range(testsets.FEW + 4) for k in (0, 1)}
    rows = spark.createDataFrame([(i, x, f"42|{i}|1#{k}") for i, x in lists.items() for k in (0, 10)], "example_id string, items array<string>, seed string")
    got = testsets.with_ordering_by_seed(rows, "made").withColumn("again", testsets.ordering_by_seed(F.col("items"), F.col("seed"))).collect()
    for r in got:
        base, k = r["seed"].split("#")
        want = [x for _, x in sorted((md5(f"{base}|{x}".encode()).hexdigest()[2 * int(k) : 2 * int(k) + 12], x) for x in r["items"])]
        assert r["made"] == want == r["again"]


def test_retries_are_compared_in_their_rows(spark):
    plan = _optimized(spark, "ord_2_retry")
    assert plan.count("Aggregate [") <= _optimized(spark, "ins_1_instances").count("Aggregate [") + 1 and "pivot" not in plan.lower()
