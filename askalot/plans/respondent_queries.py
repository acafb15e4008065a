"""Registered queries of profiles as asked for, targets, country options and the dataset builder, and SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import each_of
from ..operators import builder as bld
from ..operators import country as cty
from ..operators import decode as dec
from ..operators import profiles as prf
from ..operators import respondents as rsp
from ..sources import star_survey as star
from .survey_queries import CONFIG, TARGETS, answers, decoded

ALWAYS, BARRED = ("SEG", "BAL"), ("DISC",)
ASKED = ["PRIO", "QTY", "PARTY", "YEAR", "SEG"]
SECTIONS = ["demographics", "orders", "basket", "politics"]
BRAND = {"brand_voted": ["brd"]}


def listed(rows: DataFrame, name: str = "features") -> DataFrame:
    """Codes of each profile that has any. A plain filter on its size would be pushed below and compute the profile a second time."""
    codes = F.array_join(F.transform(name, lambda a: a["code"]), "|")
    return each_of(rows, F.array(F.nullif(codes, F.lit(""))), "codes", "respondent_id")


def prf_4_pool_per_target(spark, d):
    """Each target's own exclusions bar features for it alone."""
    barred = spark.createDataFrame([("PRIO", ["STAT", "YEAR"]), ("PARTY", ["SEG"])], "target_code string, excluded array<string>")
    rows = rsp.instances(answers(spark, d), TARGETS, rsp.Draw(CONFIG), "star", exclusions=barred)
    return rows.select("example_id", F.array_join(F.transform("questions", lambda x: F.concat(x["question"], F.lit("="), x["answer"])), "|").alias("questions"))


def prf_5_pool_statistics(spark, d):
    """Valid answers by section that can be drawn from, over all respondents."""
    pool = rsp.pool_of(F.col("answers"), rsp.Draw(CONFIG, tuple(TARGETS)))
    rows = answers(spark, d).select(F.explode(pool).alias("a"))
    return rows.groupBy("a.section").agg(F.count_distinct("a.code").alias("n_codes"), F.count(F.lit(1)).alias("n_answers"))


def prf_6_exclusions(spark, d):
    draw = rsp.Draw(CONFIG, ("STAT",)).exclude([*TARGETS, *BARRED])
    return listed(rsp.with_profile(answers(spark, d), draw))


def prf_7_always_include(spark, d):
    return listed(rsp.with_profile(answers(spark, d), rsp.Draw(CONFIG, tuple(TARGETS), ALWAYS)))


def prf_12_shuffle(spark, d):
    return listed(rsp.with_profile(answers(spark, d), rsp.Draw(CONFIG, tuple(TARGETS), ALWAYS, shuffle=True)))


def prf_14_expand(spark, d):
    draw = rsp.Draw(prf.ProfileConfig(2, 1, 42), tuple(TARGETS))
    return listed(rsp.with_expanded(rsp.with_profile(answers(spark, d), draw), draw, 1, 1), "expanded")


def prf_15_batch(spark, d):
    """Profiles of sampled respondents: the draw for all of them at once."""
    people = prf.sample_respondents(star.wide(spark, d), 200, 42)
    return listed(rsp.with_profile(answers(spark, d).join(people, "respondent_id", "left_semi"), rsp.Draw(CONFIG, tuple(TARGETS))))


def prf_18_statistics(spark, d):
    rows = rsp.with_profile(answers(spark, d), rsp.Draw(CONFIG, tuple(TARGETS), ALWAYS))
    n = F.size("features")
    sections = F.size(F.array_distinct(F.transform("features", lambda a: a["section"])))
    return rows.select(n.alias("n_features"), sections.alias("n_sections"), F.lit(CONFIG.profile_type).alias("profile_type")).groupBy("n_features", "n_sections", "profile_type").agg(F.count(F.lit(1)).alias("n"))


def dec_6_options_report(spark, d):
    """Answers to each question by whether their label means no answer."""
    missing = dec.is_missing(F.col("label"))
    return decoded(spark, d).groupBy("code").agg(F.count_distinct(F.when(missing, F.col("label"))).alias("removed"), F.count_distinct(F.when(~missing, F.col("label"))).alias("kept"))


def dec_7_feature_info(spark, d):
    rows = answers(spark, d).select("respondent_id", F.explode("answers").alias("a"))
    return rows.select("respondent_id", *[F.col(f"a.{c}") for c in ("section", "code", "question", "raw", "label")])


def tgt_1_sample(spark, d):
    """Targets drawn from variables that someone answered, the brand's variables replaced by the concept's representative."""
    variables, values = star.codebook(spark)
    seen = decoded(spark, d).select("code").distinct()
    own = variables.join(seen, "code", "left_semi")
    concepts = cty.concept_vars(variables, "brand_voted", ["brd"], star.wide(spark, d))
    return rsp.sample_targets(own, values, 5, 42, ("basket",), concepts, cty.representatives(concepts))


def tgt_2_targets(spark, d):
    """How often each resolved target is answered, with its options."""
    variables, values = star.codebook(spark)
    asked = rsp.target_rows(variables, values, ASKED)
    counts = decoded(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n_answers"))
    return asked.join(counts, "code").select("code", "section", "question", F.array_join("options", "|").alias("options"), "n_answers")


def tgt_3_filtering(spark, d):
    """Options before and after those that mean no answer are filtered, over the targets that someone answered."""
    variables, values = star.codebook(spark)
    rows = rsp.target_rows(variables, values, ASKED).join(decoded(spark, d).select("code").distinct(), "code", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n_targets"), F.sum("n_options").alias("n_original"), F.sum(F.size("options")).alias("n_filtered"))


def flagged(spark, d) -> DataFrame:
    return cty.country_specific(cty.option_spread(decoded(spark, d), star.wide(spark, d)))


def cty_3_options(spark, d):
    """Instances whose options are those of the respondent's country where the question is country-specific."""
    options = cty.country_options(decoded(spark, d), star.codebook(spark)[1]).join(flagged(spark, d).where("country_specific").select("code"), "code", "left_semi")
    rows = rsp.instances(answers(spark, d), ["PARTY", "PRIO"], rsp.Draw(CONFIG), "star", country_options=options)
    return rows.select("example_id", "answer", F.array_join("options", "|").alias("options"))


def cty_4_option_counts(spark, d):
    """Options of the codebook against the average of the countries."""
    variables, values = star.codebook(spark)
    return cty.option_counts(cty.country_options(decoded(spark, d), values), rsp.target_rows(variables, values))


def cty_5_override(spark, d):
    """A list of codes in place of detection, for questions that are answered; codes that aren't targets are named."""
    return cty.override(flagged(spark, d).select("code"), ["PARTY", "DISC", "NOSUCH"])


def concepts(spark, d) -> DataFrame:
    return cty.concepts(star.codebook(spark)[0], BRAND, star.wide(spark, d))


def cty_8_representatives(spark, d):
    return cty.representatives(concepts(spark, d))


def cty_9_all_variables(spark, d):
    return concepts(spark, d).select("concept", "code").distinct()


def cty_11_labels(spark, d):
    """Lookup C: the label of a respondent's answer to the concept's variable of their country."""
    return bld.concept_answers(answers(spark, d), concepts(spark, d)).select("concept", "respondent_id", "code", "label")


def cty_13_country_codes(spark, d):
    """Codes of the country variable's labels that respondents use."""
    values = star.codebook(spark)[1]
    used = decoded(spark, d).where("code = 'REG'").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return cty.codes_of(values, "REG").join(used, "raw")


def cty_14_presets(spark, d):
    """Presets joined to a codebook: those with enough countries, and how many answers they reach."""
    found = cty.concepts(star.codebook(spark)[0], cty.PRESETS | BRAND, star.wide(spark, d))
    return cty.coverage(decoded(spark, d), found).groupBy("concept").agg(F.count(F.lit(1)).alias("n_countries"), F.sum("n_answers").alias("n_answers"))


def ins_2_shared(spark, d):
    """Without exclusions of a target, all instances of a respondent share one profile."""
    rows = rsp.instances(answers(spark, d), TARGETS, rsp.Draw(CONFIG), "star")
    shown = F.to_json("questions")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_instances"), F.count_distinct(shown).alias("n_profiles"))


def ins_8_concepts(spark, d):
    rows = bld.concept_instances(answers(spark, d), concepts(spark, d), rsp.Draw(CONFIG), "star")
    return rows.select("example_id", "country", "target_concept", "target_code", "answer", F.array_join("options", "|").alias("options"), F.size("questions").alias("n_questions"))


def dataset(spark, d, survey: str = "star", seed: int = 42) -> DataFrame:
    variables, values = star.codebook(spark)
    return bld.build_survey_dataset(bld.Survey(survey, star.wide(spark, d), variables, values, star.CODES, BRAND), rsp.Draw(prf.ProfileConfig(3, 2, seed)), 4, 1000)


def ins_9_survey(spark, d):
    return dataset(spark, d).select("example_id", "target_concept", "target_code", "answer", F.array_join("options", "|").alias("options"), F.size("questions").alias("n_questions"))


def ins_10_surveys(spark, d):
    variables, values = star.codebook(spark)
    two = [bld.Survey(name, star.wide(spark, d), variables, values, star.CODES, BRAND) for name in ("star", "moon")]
    rows, _ = bld.build_dataset(two, rsp.Draw(CONFIG), 4, 1000)
    return bld.summary(rows)


def ins_4_dataset(spark, d):
    """Instances of sampled respondents."""
    people = prf.sample_respondents(star.wide(spark, d), 100, 42)
    rows = rsp.instances(answers(spark, d).join(people, "respondent_id", "left_semi"), TARGETS, rsp.Draw(CONFIG), "star")
    return rows.select("example_id", "target_code", "answer")


def ins_11_projections(spark, d):
    rows = rsp.full_dict(rsp.instances(answers(spark, d), TARGETS, rsp.Draw(CONFIG), "star"))
    return rows.select("example_id", "target_code", "_metadata.base_id", "_metadata.n_features", "_metadata.profile_type", "_metadata.target_section")


def level_instances(spark, d) -> DataFrame:
    """Instances at two richness levels over one reading of the answers."""
    rows, found = answers(spark, d), None
    for n, m in ((2, 1), (3, 2)):
        level = rsp.instances(rows, TARGETS, rsp.Draw(prf.ProfileConfig(n, m, 42)), "star")
        found = level if found is None else found.unionByName(level)
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        prf_4_pool_per_target, prf_5_pool_statistics, prf_6_exclusions, prf_7_always_include, prf_12_shuffle, prf_14_expand, prf_15_batch, prf_18_statistics, dec_6_options_report, dec_7_feature_info,
        tgt_1_sample, tgt_2_targets, tgt_3_filtering, cty_3_options, cty_4_option_counts, cty_5_override, cty_8_representatives, cty_9_all_variables, cty_11_labels, cty_13_country_codes, cty_14_presets,
        ins_2_shared, ins_4_dataset, ins_8_concepts, ins_9_survey, ins_10_surveys, ins_11_projections,
    )
}


def _in(codes) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


def profile_ctes(excluded, always=(), n: int = 3, m: int = 2, seed: int = 42, name: str = "p") -> str:
    """Common table expressions (after those of the star survey) up to ``{name}``: respondent_id, section, section_pos, code, question, label, pick, ord."""
    miss = dec.missing_sql("label")
    out = _in([*excluded, *always, ""])
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(always))
    first = f"UNION ALL SELECT d.respondent_id, v.section, v.section_pos, d.code, v.question, d.label, 0, CASE d.code {order} END FROM dec d JOIN vars v ON v.code = d.code WHERE d.code IN {_in(always)} AND NOT {dec.missing_sql('d.label')}" if always else ""
    return f"""{name}_s AS (SELECT respondent_id, section FROM (SELECT w.respondent_id, s.section, row_number() OVER (PARTITION BY w.respondent_id ORDER BY md5(concat_ws('|', '{seed}', w.respondent_id, 'S', s.section)), s.section) AS r
   FROM (SELECT DISTINCT respondent_id FROM wide) w, (SELECT DISTINCT section FROM vars) s) WHERE r <= {n}),
{name}_f AS (SELECT * FROM (SELECT d.respondent_id, v.section, v.section_pos, d.code, v.question, d.label, row_number() OVER (PARTITION BY d.respondent_id, v.section ORDER BY md5(concat_ws('|', '{seed}', d.respondent_id, v.section, d.code)), d.code) AS pick
   FROM dec d JOIN vars v ON v.code = d.code WHERE d.code NOT IN {out} AND NOT {miss}) WHERE pick <= {m}),
{name} AS (SELECT f.*, 1000 + f.section_pos * 100 + pick AS ord FROM {name}_f f JOIN {name}_s s ON s.respondent_id = f.respondent_id AND s.section = f.section {first})"""


def instance_sql(targets, n: int = 3, m: int = 2, seed: int = 42, name: str = "p", survey: str = "star") -> str:
    """Up to ``{name}_i``: regular instances with ``nq`` questions."""
    prof = profile_ctes(targets, (), n, m, seed, name)
    return f"""{prof},
{name}_q AS (SELECT respondent_id, count(DISTINCT question) AS nq FROM {name} GROUP BY 1),
{name}_o AS (SELECT code, list(label ORDER BY label_pos) AS options FROM vals WHERE NOT {dec.missing_sql('label')} GROUP BY code),
{name}_i AS (SELECT '{survey}_' || d.respondent_id || '_' || d.code AS base_id, 's{n}m{m}' AS profile_type, d.respondent_id AS id, d.country, d.code AS target_code, v.section AS target_section, d.blabel AS answer, q.nq,
   CASE WHEN list_contains(o.options, d.blabel) THEN o.options ELSE list_append(o.options, d.blabel) END AS options
   FROM dec d JOIN vars v ON v.code = d.code JOIN {name}_o o ON o.code = d.code JOIN {name}_q q ON q.respondent_id = d.respondent_id WHERE d.code IN {_in(targets)} AND NOT {dec.missing_sql('d.blabel')})"""


def level_instance_ctes() -> str:
    return f"{star.oracle_ctes()}, {instance_sql(TARGETS, 2, 1, name='a')}, {instance_sql(TARGETS, name='b')}, linst AS (SELECT * FROM a_i UNION ALL SELECT * FROM b_i)"


CONCEPT = """con0 AS (SELECT section, code, var_pos, upper(right(rtrim(substr(code, 4), '0123456789'), 2)) AS country FROM vars WHERE starts_with(code, 'brd')),
con1 AS (SELECT * FROM con0 WHERE country IN (SELECT country FROM wide)),
con AS (SELECT 'brand_voted' AS concept, section, country, code, var_pos, row_number() OVER (PARTITION BY country ORDER BY var_pos) - 1 AS pos FROM con1 WHERE (SELECT count(DISTINCT country) FROM con1) >= 3)"""


def concept_sql(excluded, name: str = "c", survey: str = "star", seed: int = 42) -> str:
    """Up to ``{name}_i``: concept instances, the concepts' variables barred as features."""
    prof = profile_ctes([*excluded, "brdaa", "brdab", "brdac1", "brdac2"], (), 3, 2, seed, name)
    return f"""{prof},
{name}_q AS (SELECT respondent_id, count(DISTINCT question) AS nq FROM {name} GROUP BY 1),
{name}_i AS (SELECT '{survey}_' || d.respondent_id || '_' || c.concept || '_s3m2' AS example_id, d.country, c.concept AS target_concept, d.code AS target_code, d.label AS answer, q.nq,
   CASE WHEN list_contains(o.options, d.label) THEN o.options ELSE list_append(o.options, d.label) END AS options
   FROM dec d JOIN con c ON c.code = d.code AND c.country = d.country AND c.pos = 0 JOIN (SELECT code, list(label ORDER BY label_pos) AS options FROM vals WHERE NOT {dec.missing_sql('label')} GROUP BY code) o ON o.code = d.code
   JOIN {name}_q q ON q.respondent_id = d.respondent_id WHERE NOT {dec.missing_sql('d.label')})"""


def dataset_sql(survey: str = "star", seed: int = 42, n_targets: int = 4, n_people: int = 1000) -> str:
    """SQL of the builder's rows: targets are drawn in SQL as well."""
    drawn = f"""tq AS (SELECT code FROM (SELECT DISTINCT v.code FROM vars v JOIN vals USING (code) WHERE v.code NOT IN (SELECT code FROM con) UNION SELECT concept FROM con) ORDER BY md5('{seed}|' || code), code LIMIT {n_targets}),
people AS (SELECT respondent_id FROM (SELECT DISTINCT respondent_id FROM wide) ORDER BY md5('{seed}|' || respondent_id), respondent_id LIMIT {n_people}),
hit AS (SELECT count(*) AS k FROM tq WHERE code = 'brand_voted'),
barred AS (SELECT code FROM tq UNION SELECT code FROM con WHERE (SELECT k FROM hit) > 0)"""
    miss = dec.missing_sql("label")
    return f"""{star.oracle_ctes()}, {CONCEPT}, {drawn},
s AS (SELECT respondent_id, section FROM (SELECT w.respondent_id, s.section, row_number() OVER (PARTITION BY w.respondent_id ORDER BY md5(concat_ws('|', '{seed}', w.respondent_id, 'S', s.section)), s.section) AS r
   FROM people w, (SELECT DISTINCT section FROM vars WHERE code NOT IN (SELECT code FROM barred)) s) WHERE r <= 3),
f AS (SELECT * FROM (SELECT d.respondent_id, v.section, v.question, row_number() OVER (PARTITION BY d.respondent_id, v.section ORDER BY md5(concat_ws('|', '{seed}', d.respondent_id, v.section, d.code)), d.code) AS pick
   FROM dec d JOIN vars v ON v.code = d.code WHERE d.code NOT IN (SELECT code FROM barred) AND NOT {miss}) WHERE pick <= 2),
q AS (SELECT f.respondent_id, count(DISTINCT question) AS nq FROM f JOIN s ON s.respondent_id = f.respondent_id AND s.section = f.section GROUP BY 1),
o AS (SELECT code, list(label ORDER BY label_pos) AS options FROM vals WHERE NOT {miss} GROUP BY code),
seen AS (SELECT country, code, list(label ORDER BY label_pos) AS options FROM (SELECT DISTINCT d.country, d.code, d.label, v.label_pos FROM dec d JOIN (SELECT code, label, min(label_pos) AS label_pos FROM vals GROUP BY ALL) v ON v.code = d.code AND v.label = d.label
   WHERE NOT {dec.missing_sql('d.label')}) GROUP BY ALL),
spread AS (SELECT g.code FROM (SELECT code, count(DISTINCT raw) AS n FROM dec WHERE NOT {miss} GROUP BY 1) g JOIN (SELECT code, sum(n) AS n FROM (SELECT code, country, count(DISTINCT raw) AS n FROM dec GROUP BY ALL) GROUP BY 1) p ON p.code = g.code,
   (SELECT count(DISTINCT country) AS k FROM wide) WHERE k > 1 AND g.n > 1 AND p.n / k / g.n < 0.5),
reg AS (SELECT '{survey}_' || d.respondent_id || '_' || d.code || '_s3m2' AS example_id, NULL AS target_concept, d.code AS target_code, d.blabel AS answer, q.nq,
   CASE WHEN d.code IN (SELECT code FROM spread) THEN coalesce(seen.options, o.options) ELSE o.options END AS opts
   FROM dec d JOIN tq ON tq.code = d.code JOIN o ON o.code = d.code JOIN q ON q.respondent_id = d.respondent_id LEFT JOIN seen ON seen.country = d.country AND seen.code = d.code WHERE NOT {dec.missing_sql('d.blabel')}),
cin AS (SELECT '{survey}_' || d.respondent_id || '_' || c.concept || '_s3m2' AS example_id, c.concept AS target_concept, d.code AS target_code, d.label AS answer, q.nq, o.options AS opts
   FROM dec d JOIN con c ON c.code = d.code AND c.country = d.country AND c.pos = 0 JOIN o ON o.code = d.code JOIN q ON q.respondent_id = d.respondent_id WHERE (SELECT k FROM hit) > 0 AND NOT {dec.missing_sql('d.label')}),
ds AS (SELECT example_id, target_concept, target_code, answer, CASE WHEN list_contains(opts, answer) THEN opts ELSE list_append(opts, answer) END AS options, nq FROM (SELECT * FROM reg UNION ALL SELECT * FROM cin))"""


def oracles() -> dict[str, str]:
    with_, miss = star.oracle_ctes(), dec.missing_sql("label")
    codes = lambda p, order: f"SELECT respondent_id, string_agg(code, '|' ORDER BY {order}) AS codes FROM {p} GROUP BY 1"
    barred = {"PRIO": ["STAT", "YEAR"], "PARTY": ["SEG"], "QTY": []}
    per_target = ", ".join(f"{profile_ctes([*TARGETS, *own], name=f'p{t.lower()}')}" for t, own in barred.items())
    per_union = " UNION ALL ".join(f"SELECT '{t}' AS target, * FROM p{t.lower()}" for t in barred)
    spread = f"""per AS (SELECT code, country, count(DISTINCT raw) AS n FROM dec GROUP BY ALL), k AS (SELECT count(DISTINCT country) AS k FROM wide),
g AS (SELECT code, count(DISTINCT raw) AS n_global FROM dec WHERE NOT {miss} GROUP BY code),
spread AS (SELECT g.code, sum(n) / max(k) / g.n_global < 0.5 AS country_specific FROM per JOIN g ON g.code = per.code, k WHERE k > 1 AND n_global > 1 GROUP BY g.code, g.n_global)"""
    seen = f"""seen AS (SELECT country, code, list(label ORDER BY label_pos) AS options FROM (SELECT DISTINCT d.country, d.code, d.label, v.label_pos FROM dec d JOIN (SELECT code, label, min(label_pos) AS label_pos FROM vals GROUP BY ALL) v
   ON v.code = d.code AND v.label = d.label WHERE NOT {dec.missing_sql('d.label')}) GROUP BY ALL)"""
    grown = f"""{with_}, {profile_ctes(TARGETS, n=2, m=1, name='b')},
old AS (SELECT DISTINCT respondent_id, section FROM b),
fresh AS (SELECT respondent_id, section FROM (SELECT w.respondent_id, s.section, row_number() OVER (PARTITION BY w.respondent_id ORDER BY md5(concat_ws('|', '42', w.respondent_id || '_expand_1_1', 'S', s.section)), s.section) AS r
   FROM (SELECT DISTINCT respondent_id FROM wide) w, (SELECT DISTINCT section FROM vars) s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.respondent_id = w.respondent_id AND o.section = s.section)) WHERE r <= 1),
more AS (SELECT d.respondent_id, v.section, v.section_pos, d.code, row_number() OVER (PARTITION BY d.respondent_id, v.section ORDER BY md5(concat_ws('|', '42', d.respondent_id || '_expand_1_1', v.section, d.code)), d.code) AS pick
   FROM dec d JOIN vars v ON v.code = d.code WHERE d.code NOT IN {_in(TARGETS)} AND NOT {miss} AND NOT EXISTS (SELECT 1 FROM b WHERE b.respondent_id = d.respondent_id AND b.code = d.code)),
ex AS (SELECT respondent_id, code, ord FROM b UNION ALL SELECT m.respondent_id, m.code, 5000 + section_pos * 100 + pick FROM more m JOIN old o ON o.respondent_id = m.respondent_id AND o.section = m.section WHERE pick <= 1
   UNION ALL SELECT m.respondent_id, m.code, 9000 + section_pos * 100 + pick FROM more m JOIN fresh o ON o.respondent_id = m.respondent_id AND o.section = m.section WHERE pick <= 2)"""
    ins_sql = f"{with_}, {instance_sql(TARGETS)}"
    asked = ", ".join(f"'{c}'" for c in ASKED)
    labels = f"(SELECT code, count(*) AS n_options, list(label ORDER BY label_pos) FILTER (WHERE NOT {miss}) AS options FROM vals GROUP BY code)"
    con = f"{with_}, {CONCEPT}"
    return {
        "prf_4_pool_per_target": f"""{with_}, {per_target}, every AS ({per_union}), a AS (SELECT target, respondent_id, question, min(ord) AS pos, arg_max(label, ord) AS answer FROM every GROUP BY ALL),
            q AS (SELECT target, respondent_id, string_agg(question || '=' || answer, '|' ORDER BY pos) AS questions FROM a GROUP BY ALL)
            SELECT 'star_' || d.respondent_id || '_' || d.code || '_s3m2' AS example_id, q.questions FROM dec d JOIN q ON q.respondent_id = d.respondent_id AND q.target = d.code WHERE NOT {dec.missing_sql('d.blabel')}""",
        "prf_5_pool_statistics": f"{with_} SELECT v.section, count(DISTINCT d.code) AS n_codes, count(*) AS n_answers FROM dec d JOIN vars v ON v.code = d.code WHERE d.code NOT IN {_in(TARGETS)} AND NOT {dec.missing_sql('d.label')} GROUP BY 1",
        "prf_6_exclusions": f"{with_}, {profile_ctes(['STAT', *TARGETS, *BARRED])} {codes('p', 'ord')}",
        "prf_7_always_include": f"{with_}, {profile_ctes(TARGETS, ALWAYS)} {codes('p', 'ord')}",
        "prf_12_shuffle": f"{with_}, {profile_ctes(TARGETS, ALWAYS)} {codes('p', ''' md5(concat_ws('|', '42', respondent_id, 'F', code)) ''')}",
        "prf_14_expand": f"{grown} {codes('ex', 'ord')}",
        "prf_15_batch": f"{with_}, {profile_ctes(TARGETS)}, people AS (SELECT respondent_id FROM (SELECT DISTINCT respondent_id FROM wide) ORDER BY md5('42|' || respondent_id), respondent_id LIMIT 200) {codes('p JOIN people USING (respondent_id)', 'ord')}",
        "prf_18_statistics": f"""{with_}, {profile_ctes(TARGETS, ALWAYS)}, per AS (SELECT w.respondent_id, count(p.code) AS n_features, count(DISTINCT p.section) AS n_sections FROM (SELECT DISTINCT respondent_id FROM wide) w LEFT JOIN p ON p.respondent_id = w.respondent_id GROUP BY 1)
            SELECT n_features, n_sections, 's3m2' AS profile_type, count(*) AS n FROM per GROUP BY 1, 2""",
        "dec_6_options_report": f"{with_} SELECT code, count(DISTINCT label) FILTER (WHERE {miss}) AS removed, count(DISTINCT label) FILTER (WHERE NOT {miss}) AS kept FROM dec GROUP BY 1",
        "dec_7_feature_info": f"{with_} SELECT d.respondent_id, v.section, d.code, v.question, d.raw, d.label FROM dec d JOIN vars v ON v.code = d.code",
        "tgt_1_sample": f"""{con} SELECT code, section FROM (SELECT DISTINCT v.code, v.section FROM vars v JOIN vals x ON x.code = v.code WHERE v.section <> 'basket' AND v.code IN (SELECT code FROM dec) AND v.code NOT IN (SELECT code FROM con)
            UNION ALL SELECT concept, '__concept__' FROM con GROUP BY concept) ORDER BY md5('42|' || code), code LIMIT 5""",
        "tgt_2_targets": f"{with_} SELECT v.code, v.section, v.question, array_to_string(l.options, '|') AS options, (SELECT count(*) FROM dec d WHERE d.code = v.code) AS n_answers FROM vars v JOIN {labels} l ON l.code = v.code WHERE v.code IN ({asked})",
        "tgt_3_filtering": f"{with_} SELECT count(*) AS n_targets, sum(n_options)::BIGINT AS n_original, sum(len(options))::BIGINT AS n_filtered FROM vars v JOIN {labels} l ON l.code = v.code WHERE v.code IN ({asked}) AND v.code IN (SELECT code FROM dec)",
        "cty_3_options": f"""{with_}, {spread}, {seen}, {instance_sql(['PARTY', 'PRIO'])}, picked AS (SELECT i.base_id, i.answer, coalesce(CASE WHEN s.country_specific THEN x.options END, o.options) AS options
            FROM p_i i JOIN p_o o ON o.code = i.target_code LEFT JOIN spread s ON s.code = i.target_code LEFT JOIN seen x ON x.country = i.country AND x.code = i.target_code)
            SELECT base_id || '_s3m2' AS example_id, answer, array_to_string(CASE WHEN list_contains(options, answer) THEN options ELSE list_append(options, answer) END, '|') AS options FROM picked""",
        "cty_4_option_counts": f"{with_}, {seen} SELECT l.code, len(l.options) AS n_global, round(avg(len(s.options)), 6) AS avg_country FROM seen s JOIN {labels} l ON l.code = s.code GROUP BY ALL",
        "cty_5_override": f"{with_}, {spread} SELECT x.code, s.code IS NOT NULL AS known FROM (VALUES ('PARTY'), ('DISC'), ('NOSUCH')) x(code) LEFT JOIN spread s ON s.code = x.code",
        "cty_8_representatives": f"{con} SELECT concept AS code, '__concept__' AS section, arg_min(code, var_pos) AS first_code FROM con GROUP BY concept",
        "cty_9_all_variables": f"{con} SELECT DISTINCT concept, code FROM con",
        "cty_11_labels": f"{con} SELECT concept, respondent_id, d.code, label FROM dec d JOIN con c ON c.country = d.country AND c.code = d.code WHERE pos = 0",
        "cty_13_country_codes": f"{with_} SELECT v.raw, v.label, count(*) AS n FROM vals v JOIN dec d ON d.code = v.code AND d.raw = v.raw WHERE v.code = 'REG' GROUP BY 1, 2",
        "cty_14_presets": f"{con} SELECT concept, count(DISTINCT c.country) AS n_countries, count(d.raw) AS n_answers FROM con c LEFT JOIN dec d ON d.country = c.country AND d.code = c.code GROUP BY 1",
        "ins_2_shared": f"{ins_sql} SELECT id, count(*) AS n_instances, 1 AS n_profiles FROM p_i GROUP BY 1",
        "ins_4_dataset": f"{ins_sql}, people AS (SELECT respondent_id FROM (SELECT DISTINCT respondent_id FROM wide) ORDER BY md5('42|' || respondent_id), respondent_id LIMIT 100) SELECT base_id || '_s3m2' AS example_id, target_code, answer FROM p_i WHERE id IN (SELECT respondent_id FROM people)",
        "ins_8_concepts": f"{con}, {concept_sql([])} SELECT example_id, country, target_concept, target_code, answer, array_to_string(options, '|') AS options, nq AS n_questions FROM c_i",
        "ins_9_survey": f"{dataset_sql()}, kept AS (SELECT * FROM ds WHERE example_id IS NOT NULL) SELECT example_id, target_concept, target_code, answer, array_to_string(options, '|') AS options, nq AS n_questions FROM kept",
        "ins_10_surveys": f"""{dataset_sql()}, two AS (SELECT 'star' AS survey, example_id FROM ds UNION ALL SELECT 'moon', 'moon' || substr(example_id, 5) FROM ds)
            SELECT survey, 's3m2' AS profile_type, count(*) AS n, array_to_string(list_sort(list(example_id))[1:5], '|') AS first_ids FROM two GROUP BY survey""",
        "ins_11_projections": f"{ins_sql} SELECT base_id || '_s3m2' AS example_id, target_code, base_id, nq AS n_features, 's3m2' AS profile_type, target_section FROM p_i",
    }
