"""Registered queries of the operators that others are made of, and SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answer_patterns as pat
from ..operators import country as cty
from ..operators import decode as dec
from ..operators import profiles as prf
from ..operators import respondents as rsp
from ..operators import testsets as tst
from ..sources import star_survey as star
from .respondent_queries import instance_sql, profile_ctes
from .survey_queries import CONFIG, TARGETS, answers, decoded, instances, pool
from .testset_queries import items, ordering_ctes
from .variation_queries import options, variation_ctes


def dec_4_valid_options(spark, d):
    """Options of each question with how many respondents gave an answer among them."""
    rows = decoded(spark, d).join(dec.valid_options(star.codebook(spark)[1]), "code")
    return rows.groupBy("code", F.array_join("options", "|").alias("options")).agg(F.count_if(F.array_contains("options", F.col("label"))).alias("n"))


def dec_5_valid_value(spark, d):
    valid = F.count_if(~dec.is_missing(F.col("label")))
    return decoded(spark, d).groupBy("respondent_id").agg(valid.alias("n_valid"))


def prf_3_pool(spark, d):
    """Variables that can be drawn, with their answers; sections without any drop out."""
    return decoded(spark, d).join(pool(spark).select("code", "section"), "code").groupBy("section", "code").agg(F.count(F.lit(1)).alias("n"))


def prf_8_sections(spark, d):
    return prf.draw_sections(pool(spark), star.wide(spark, d).select("respondent_id").distinct(), CONFIG).select("respondent_id", "section")


def prf_9_features(spark, d):
    return prf.draw_features(decoded(spark, d), pool(spark), CONFIG).select("respondent_id", "section", "code", "pick")


def cty_6_country_of_code(spark, d):
    """Countries in the names of variables that are answered."""
    rows = decoded(spark, d).where("code like 'brd%'").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("code", cty.country_of(F.col("code"), "brd").alias("country"), "n")


def each_option(spark, d) -> DataFrame:
    return options(spark, d).groupBy("option").agg(F.count(F.lit(1)).alias("n"))


def var_1_special(spark, d):
    return each_option(spark, d).select("option", pat.is_special(F.col("option")).alias("special"), "n")


def var_2_ineligible(spark, d):
    return each_option(spark, d).select("option", F.lower("option").rlike(pat.OPTION_RE).alias("ineligible"))


def var_3_question(spark, d):
    return decoded(spark, d).join(star.codebook(spark)[0].select("code", "question"), "code").groupBy("question").agg(F.count(F.lit(1)).alias("n")).withColumn("ineligible", F.lower("question").rlike(pat.QUESTION_RE))


def opt_1_scale_option(spark, d):
    return each_option(spark, d).select("option", pat.is_scale_option(F.col("option")).alias("scale"))


def opt_2_option_type(spark, d):
    return instances(spark, d).groupBy("target_code", tst.option_type(F.col("options")).alias("option_type")).agg(F.count(F.lit(1)).alias("n"))


def opt_3_substantive(spark, d):
    return each_option(spark, d).select("option", pat.is_substantive(F.col("option")).alias("substantive"))


def ord_2_retry(spark, d):
    """Random orderings of three or more features that equal the original or its reverse: only where no other was found. Each instance is compared in its own row."""
    rows = tst.with_orderings(instances(spark, d), items(), names=("random_1", "random_2"))
    same = F.filter("orderings", lambda o: (o["ordering"] == F.col("items")) | (o["ordering"] == F.reverse("items")))
    # Rows without orderings count for nothing; a filter on their reason would be pushed below and compute items and options again.
    return rows.agg(F.count("orderings").alias("n"), F.sum(F.when(F.col("orderings").isNotNull(), F.size(same))).alias("n_same"))


def ins_3_all_targets(spark, d):
    return instances(spark, d).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("target_code")), "|").alias("targets"))


def ins_5_appended(spark, d):
    """Years are written with a fraction, so as targets their labels are found by none of the options and come last."""
    rows = rsp.instances(answers(spark, d), ["YEAR"], rsp.Draw(CONFIG), "star")
    return rows.select("example_id", "answer", F.element_at("options", -1).alias("last"), F.size("options").alias("n_options"))


def ins_6_collapse(spark, d):
    """Two questions have the same text: profiles that hold both show it once."""
    rows = rsp.with_profile(answers(spark, d), rsp.Draw(prf.ProfileConfig(4, 5, 42), ("PRIO",)))
    return rows.groupBy(F.size("features").alias("n_features"), F.size(rsp.asked(F.col("features"))).alias("n_questions")).agg(F.count(F.lit(1)).alias("n"))


def ins_7_ids(spark, d):
    rows = answers(spark, d).withColumn("respondent_id", F.concat("respondent_id", F.lit("/a b")))
    return rsp.instances(rows, ["QTY"], rsp.Draw(CONFIG), "my star").select("id", "base_id", "example_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dec_4_valid_options, dec_5_valid_value, prf_3_pool, prf_8_sections, prf_9_features, cty_6_country_of_code, var_1_special, var_2_ineligible, var_3_question, opt_1_scale_option, opt_2_option_type,
        opt_3_substantive, ord_2_retry, ins_3_all_targets, ins_5_appended, ins_6_collapse, ins_7_ids,
    )
}


def oracles() -> dict[str, str]:
    with_, miss = star.oracle_ctes(), dec.missing_sql("label")
    v = variation_ctes() + ", each_option AS (SELECT option, count(*) AS n FROM (SELECT unnest(options) AS option FROM ins) GROUP BY 1)"
    hit = lambda c, pattern: f"regexp_matches(lower({c}), {pat.quoted(pattern)})"
    opts = f"o AS (SELECT code, list(label ORDER BY label_pos) AS options FROM vals WHERE NOT {miss} GROUP BY code)"
    out = ", ".join(f"'{t}'" for t in TARGETS)
    inst = f"{with_}, {instance_sql(TARGETS)}"
    scale = f"len(list_filter(options, lambda o: {hit('trim(o)', pat.SCALE_RE)})) * 2 >= len(options) AND len(options) >= 2"
    return {
        "dec_4_valid_options": f"{with_}, {opts} SELECT d.code, array_to_string(options, '|') AS options, count(*) FILTER (WHERE list_contains(options, label)) AS n FROM dec d JOIN o ON o.code = d.code GROUP BY 1, 2",
        "dec_5_valid_value": f"{with_} SELECT respondent_id, count(*) FILTER (WHERE NOT {miss}) AS n_valid FROM dec GROUP BY 1",
        "prf_3_pool": f"{with_} SELECT v.section, d.code, count(*) AS n FROM dec d JOIN vars v ON v.code = d.code WHERE d.code NOT IN ({out}) GROUP BY 1, 2",
        "prf_8_sections": f"{with_}, {profile_ctes(TARGETS)} SELECT respondent_id, section FROM p_s",
        "prf_9_features": f"{with_}, {profile_ctes(TARGETS)} SELECT respondent_id, section, code, pick FROM p_f",
        "cty_6_country_of_code": f"{with_} SELECT code, upper(right(rtrim(substr(code, 4), '0123456789'), 2)) AS country, count(*) AS n FROM dec WHERE code LIKE 'brd%' GROUP BY 1",
        "var_1_special": f"{v} SELECT option, lower(trim(option)) IN ({', '.join(map(pat.quoted, pat.SPECIAL))}) AS special, n FROM each_option",
        "var_2_ineligible": f"{v} SELECT option, {hit('option', pat.OPTION_RE)} AS ineligible FROM each_option",
        "var_3_question": f"{with_} SELECT question, count(*) AS n, {hit('question', pat.QUESTION_RE)} AS ineligible FROM dec d JOIN vars v ON v.code = d.code GROUP BY question",
        "opt_1_scale_option": f"{v} SELECT option, {hit('trim(option)', pat.SCALE_RE)} AS scale FROM each_option",
        "opt_2_option_type": f"{inst} SELECT target_code, CASE WHEN {scale} THEN 'scale' ELSE 'categorical' END AS option_type, count(*) AS n FROM p_i GROUP BY 1, 2",
        "opt_3_substantive": f"{v} SELECT option, {pat.substantive_sql('trim(option)')} AS substantive FROM each_option",
        "ord_2_retry": f"""{ordering_ctes()}, w AS (SELECT example_id, any_value(ordering) FILTER (WHERE name = 'original') AS o, any_value(ordering) FILTER (WHERE name = 'reversed') AS r, any_value(ordering) FILTER (WHERE name = 'random_1') AS a,
            any_value(ordering) FILTER (WHERE name = 'random_2') AS b FROM ord GROUP BY 1) SELECT count(*) AS n, sum((a = o OR a = r)::INT + (b = o OR b = r)::INT)::BIGINT AS n_same FROM w""",
        "ins_3_all_targets": f"{inst} SELECT id, string_agg(target_code, '|' ORDER BY target_code) AS targets FROM p_i GROUP BY 1",
        "ins_5_appended": f"{with_}, {instance_sql(['YEAR'])} SELECT base_id || '_s3m2' AS example_id, answer, options[-1] AS last, len(options)::INT AS n_options FROM p_i",
        "ins_6_collapse": f"""{with_}, {profile_ctes(['PRIO'], n=4, m=5)}, k AS (SELECT w.respondent_id, count(p.code)::INT AS n_features, count(DISTINCT p.question)::INT AS n_questions FROM (SELECT DISTINCT respondent_id FROM wide) w LEFT JOIN p ON p.respondent_id = w.respondent_id GROUP BY 1)
            SELECT n_features, n_questions, count(*) AS n FROM k GROUP BY 1, 2""",
        "ins_7_ids": f"{with_}, {instance_sql(['QTY'])} SELECT id || '/a b' AS id, 'my_star_' || id || '_a_b_QTY' AS base_id, 'my_star_' || id || '_a_b_QTY_s3m2' AS example_id FROM p_i",
    }
