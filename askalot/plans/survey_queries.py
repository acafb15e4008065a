"""Registered queries of the survey operators over the star survey, and SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import each_of
from ..functions.hashing import order_key, respondent_seed
from ..operators import country as cty
from ..operators import decode as dec
from ..operators import instances as ins
from ..operators import profiles as prf
from ..operators import respondents as rsp
from ..sources import star_survey as star
from ..sources.splits import parts

TARGETS = ["PRIO", "QTY", "PARTY"]
CONFIG = prf.ProfileConfig(3, 2, 42)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The wide rows are dealt by respondent once; windows and groups over them need no further shuffle.
    wide = star.wide(spark, sf_dir).repartition(parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet")), "respondent_id")
    return dec.decode_answers(dec.to_long(wide, star.CODES), star.codebook(spark)[1])


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per respondent with all answers: one scan of the survey, no exchange of it."""
    return rsp.answer_rows(star.wide(spark, sf_dir), rsp.book(*star.codebook(spark), star.CODES), star.CODES)


def pool(spark: SparkSession) -> DataFrame:
    return prf.feature_pool(star.codebook(spark)[0], excluded=TARGETS)


def cln_9_long(spark, d):
    return dec.to_long(star.wide(spark, d), star.CODES)


def dec_1_decode(spark, d):
    return decoded(spark, d).select("respondent_id", "code", "raw", "label")


def dec_2_strict(spark, d):
    return dec.decode_answers(dec.to_long(star.wide(spark, d), star.CODES), star.codebook(spark)[1], strict_int=True).groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"))


def dec_3_missing(spark, d):
    return decoded(spark, d).groupBy("code").agg(F.count_if(dec.is_missing(F.col("label"))).alias("n_missing"), F.count(F.lit(1)).alias("n"))


def prf_1_seed(spark, d):
    return star.wide(spark, d).select("respondent_id", respondent_seed(42, F.col("respondent_id")).alias("seed"))


def prf_2_sample(spark, d):
    return prf.sample_respondents(star.wide(spark, d), 1000, 42)


def prf_11_shortfall(spark, d):
    return prf.shortfall(decoded(spark, d), pool(spark), CONFIG)


def prf_13_profile(spark, d):
    rows = rsp.with_profile(answers(spark, d), rsp.Draw(CONFIG, tuple(TARGETS)))
    return each_of(rows, F.col("features"), "f", "respondent_id").select("respondent_id", "f.section", "f.code", "f.label", "f.pick")


def cty_1_detect(spark, d):
    return cty.option_spread(decoded(spark, d), star.wide(spark, d))


def cty_2_options(spark, d):
    return cty.country_options(decoded(spark, d), star.codebook(spark)[1]).withColumn("options", F.array_join("options", "|"))


def instances(spark, d):
    return rsp.direct_instances(star.wide(spark, d), rsp.book(*star.codebook(spark), star.CODES), star.CODES, TARGETS, rsp.Draw(CONFIG), "star")


def ins_1_instances(spark, d):
    asked = F.array_join(F.transform("questions", lambda x: F.concat(x["question"], F.lit("="), x["answer"])), "|")
    return instances(spark, d).select("example_id", "base_id", "id", "country", asked.alias("questions"), "target_code", "answer", F.array_join("options", "|").alias("options"))


def fmt_14_prompt(spark, d):
    return ins.to_prompt(instances(spark, d)).select("example_id", "prompt")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (cln_9_long, dec_1_decode, dec_2_strict, dec_3_missing, prf_1_seed, prf_2_sample, prf_11_shortfall, prf_13_profile, cty_1_detect, cty_2_options, ins_1_instances, fmt_14_prompt)
}


def instance_ctes() -> tuple[str, str]:
    """Common table expressions up to ``prof`` (drawn features) and up to ``inst`` (instances)."""
    with_ = star.oracle_ctes()
    miss = dec.missing_sql("label")
    not_targets = "code NOT IN (" + ", ".join(f"'{t}'" for t in TARGETS) + ")"
    is_target = not_targets.replace("NOT IN", "IN")
    prof = f"""{with_},
pool AS (SELECT * FROM vars WHERE {not_targets}),
secs AS (SELECT respondent_id, section FROM (SELECT w.respondent_id, s.section, row_number() OVER (PARTITION BY w.respondent_id ORDER BY md5(concat_ws('|', '42', w.respondent_id, 'S', s.section)), s.section) AS r
         FROM (SELECT DISTINCT respondent_id FROM dec) w, (SELECT DISTINCT section FROM pool) s) WHERE r <= 3),
feat AS (SELECT * FROM (SELECT d.*, p.section, p.section_pos, p.question, row_number() OVER (PARTITION BY d.respondent_id, p.section ORDER BY md5(concat_ws('|', '42', d.respondent_id, p.section, d.code)), d.code) AS pick
         FROM dec d JOIN pool p ON p.code = d.code WHERE NOT {miss}) WHERE pick <= 2),
prof AS (SELECT f.* FROM feat f JOIN secs s ON s.respondent_id = f.respondent_id AND s.section = f.section)"""
    inst = f"""{prof},
asked AS (SELECT respondent_id, question, min(section_pos * 100 + pick) AS pos, arg_max(label, section_pos * 100 + pick) AS answer FROM prof GROUP BY ALL),
qs AS (SELECT respondent_id, string_agg(question || '=' || answer, '|' ORDER BY pos) AS questions, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) ORDER BY pos) AS lines, string_agg(question || ': ' || answer, chr(10) ORDER BY pos) AS colons FROM asked GROUP BY respondent_id),
opts AS (SELECT code, list(label ORDER BY label_pos) AS options FROM vals WHERE NOT {miss} GROUP BY code),
inst AS (SELECT 'star_' || d.respondent_id || '_' || d.code AS base_id, d.respondent_id AS id, d.country, q.questions, q.lines, q.colons, d.code AS target_code, v.question AS target_question, v.section AS target_section, d.blabel AS answer, d.raw AS answer_raw,
                CASE WHEN list_contains(o.options, d.blabel) THEN o.options ELSE list_append(o.options, d.blabel) END AS options
         FROM dec d JOIN vars v ON v.code = d.code JOIN opts o ON o.code = d.code JOIN qs q ON q.respondent_id = d.respondent_id WHERE d.{is_target} AND NOT {dec.missing_sql('d.blabel')})"""
    return prof, inst


def oracles() -> dict[str, str]:
    with_ = star.oracle_ctes()
    miss = dec.missing_sql("label")
    not_targets = "code NOT IN (" + ", ".join(f"'{t}'" for t in TARGETS) + ")"
    prof, inst = instance_ctes()
    return {
        "cln_9_long": f"{with_} SELECT respondent_id, country, code, raw FROM long",
        "dec_1_decode": f"{with_} SELECT respondent_id, code, raw, label FROM dec",
        "dec_2_strict": f"""{with_} SELECT l.code, coalesce(v1.label, v2.label, l.raw) AS label, count(*) AS n FROM long l LEFT JOIN vals v1 ON v1.code = l.code AND v1.raw = l.raw
            LEFT JOIN vals v2 ON v2.code = l.code AND regexp_full_match(l.raw, '[0-9]+') AND v2.raw = l.raw GROUP BY 1, 2""",
        "dec_3_missing": f"{with_} SELECT code, count(*) FILTER (WHERE {miss}) AS n_missing, count(*) AS n FROM dec GROUP BY code",
        "prf_1_seed": f"{with_} SELECT respondent_id, ('0x' || substr(sha256('42_' || respondent_id), 1, 8))::BIGINT AS seed FROM wide",
        "prf_2_sample": f"{with_} SELECT respondent_id FROM (SELECT DISTINCT respondent_id FROM wide) ORDER BY md5('42|' || respondent_id), respondent_id LIMIT 1000",
        "prf_11_shortfall": f"{with_} SELECT d.respondent_id, v.section, count(*) AS n_valid FROM dec d JOIN vars v ON v.code = d.code WHERE v.{not_targets} AND NOT {miss} GROUP BY 1, 2 HAVING count(*) < 2",
        "prf_13_profile": f"{prof} SELECT respondent_id, section, code, label, pick FROM prof",
        "cty_1_detect": f"""{with_}, per AS (SELECT code, country, count(DISTINCT raw) AS n FROM dec GROUP BY ALL), k AS (SELECT count(DISTINCT country) AS k FROM wide),
            g AS (SELECT code, count(DISTINCT raw) AS n_global FROM dec WHERE NOT {miss} GROUP BY code)
            SELECT g.code, g.n_global, round(sum(n) / max(k), 6) AS avg_country, round(sum(n) / max(k) / g.n_global, 6) AS ratio FROM per JOIN g ON g.code = per.code, k WHERE k > 1 AND n_global > 1 GROUP BY g.code, g.n_global""",
        "cty_2_options": f"""{with_} SELECT s.country, s.code, string_agg(s.label, '|' ORDER BY o.label_pos) AS options FROM (SELECT DISTINCT country, code, label FROM dec WHERE NOT {miss}) s
            JOIN (SELECT code, label, min(label_pos) AS label_pos FROM vals GROUP BY ALL) o ON o.code = s.code AND o.label = s.label GROUP BY 1, 2""",
        "ins_1_instances": f"{inst} SELECT base_id || '_s3m2' AS example_id, base_id, id, country, questions, target_code, answer, array_to_string(options, '|') AS options FROM inst",
        "fmt_14_prompt": f"""{inst} SELECT base_id || '_s3m2' AS example_id, 'Here is information about a survey respondent:' || chr(10) || chr(10) || colons || chr(10) || chr(10) ||
            'Based on this information, please answer:' || chr(10) || target_question || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(options, lambda o, i: i || '. ' || o), chr(10)) AS prompt FROM inst""",
    }
