"""Registered queries of codebook work, chunks and similarity, and SQL for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import artifact_patterns as art
from ..functions.answer_patterns import quoted
from ..operators import codebook as cbk
from ..operators import similarity as sim
from ..sources import part_codebook as parts

CHUNK = 400


def collapsed(raw="raw", label="label"):
    return cbk.collapse_scale(F.col(raw), cbk.normalise_label(F.col(label)), "disagree", "agree")


def cln_4_normalise(spark, d):
    return parts.codebook(spark, d)[1].select("survey", "code", "raw", cbk.normalise_label(F.col("label")).alias("label"))


def cln_5_apostrophes(spark, d):
    variables, values = parts.codebook(spark, d)
    q = variables.select("survey", "code", cbk.straighten(F.col("question")).alias("text"))
    return q.unionByName(values.select("survey", "code", cbk.straighten(F.col("label")).alias("text"))).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def cln_6_category_key(spark, d):
    return parts.codebook(spark, d)[0].groupBy(cbk.category_key(F.col("category")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def cln_7_deny_list(spark, d):
    """Without the variables that nobody ordered often."""
    variables, values = parts.codebook(spark, d)
    denied = values.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n < 10")
    return cbk.drop_listed(variables, denied).select("survey", "code", "var_pos")


def cln_8_nested(spark, d):
    """Sections as JSON; codes hold quotes, backslashes and line breaks here."""
    variables, values = parts.codebook(spark, d)
    odd = F.when(F.substring("code", -1, 1) == "7", F.concat("code", F.lit('"\\\n/'))).otherwise(F.col("code"))
    return cbk.nested_json(variables.withColumn("code", odd), values.withColumn("code", odd))


def cln_10_base_name(spark, d):
    return parts.codebook(spark, d)[0].select("survey", "code", cbk.base_name(F.col("code")).alias("base"))


def cbk_1_structure(spark, d):
    return cbk.structure(*parts.codebook(spark, d))


#: Variables of one JSON file, whose texts are told by the remainder of ``var_pos`` by 13.
FILE, FAULTS = 100, 13


def codebook_files(spark, d) -> DataFrame:
    """(survey, text): the codebook as JSON files of some variables each, with faults of every kind."""
    q, text = F.col("question"), cbk.json_text
    whole = lambda question, values: F.concat(F.lit('{"question":'), question, F.lit(',"description":'), text(F.col("description")), F.lit(f',"values":{values}}}'))
    said = text(F.coalesce(q, F.lit("What is it about?")))
    fault = F.col("var_pos") % FAULTS
    entry = (
        F.when(fault == 0, F.lit('"no object"')).when(fault == 1, F.lit('{"description":"d","values":{"1":"a"}}')).when(fault == 2, whole(said, '"String variable"')).when(fault == 3, whole(said, "{}"))
        .when(fault == 4, whole(F.lit("5"), '{"1":"a"}')).when(fault == 5, whole(said, '{"1":"a","1":"b"}')).when(fault == 6, whole(said, '{1:"a","2":"b"}')).when(fault == 7, F.concat(F.lit('{"question":'), said, F.lit(',"description":null}')))
        .when(fault == 8, whole(F.lit('"Q1"'), '{"1":"a"}')).otherwise(whole(said, '{"1":"a","2":"String {variable}: x"}'))
    )
    variables = parts.codebook(spark, d)[0].withColumn("block", F.floor(F.col("var_pos") / FILE)).withColumn("entry", F.concat(text(F.col("code")), F.lit(":"), entry))
    keys = [F.concat("survey", F.lit("/"), F.col("block").cast("string")).alias("survey"), "block"]
    sections = variables.groupBy(*keys, "section").agg(F.array_join(F.array_sort(F.collect_list("entry")), ",").alias("t"))
    shape = F.when(F.length("section") % 7 == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), "t", F.lit("}")))
    files = sections.groupBy("survey", "block").agg(F.array_join(F.array_sort(F.collect_list(F.concat(text(F.col("section")), F.lit(":"), shape))), ",").alias("t"))
    extra = F.when(F.col("block") % 3 == 0, ',"extra":{},"extra":{}').otherwise("")
    return files.select("survey", F.when(F.col("block") % 10 == 9, F.lit("{broken")).otherwise(F.concat(F.lit("{"), "t", extra, F.lit("}"))).alias("text"))


def cbk_1_files(spark, d):
    return cbk.file_structure(codebook_files(spark, d))


def artifacts(spark, d) -> DataFrame:
    return cbk.codebook_artifacts(*parts.codebook(spark, d))


def cbk_2_artifacts(spark, d):
    return artifacts(spark, d).groupBy("survey", "code", "field", "type", "pattern_name", "matched").agg(F.count(F.lit(1)).alias("n"))


def cbk_2_documents(spark, d):
    """The same audit over whole texts of any kind: matches and documents by pattern."""
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return cbk.find_artifacts(texts).groupBy("type", "pattern_name").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("doc_id").alias("n_documents"))


def cbk_3_severity(spark, d):
    return artifacts(spark, d).groupBy("pattern_name", "severity", "suggestion").agg(F.count(F.lit(1)).alias("n"))


def cbk_4_statistics(spark, d):
    variables, values = parts.codebook(spark, d)
    return cbk.audit_statistics(variables, values, artifacts(spark, d))


def cbk_5_recommendations(spark, d):
    return cbk.recommendations(artifacts(spark, d))


def cbk_7_labels(spark, d):
    return cbk.label_review(parts.codebook(spark, d)[1])


def cbk_7_open_text(spark, d):
    """Variables of the JSON files that are answered in words."""
    rows = cbk.file_variables(codebook_files(spark, d)).select("survey", "section", "code", F.from_json("t", "struct<values:string>", cbk.LOOSE).alias("v"))
    rows = rows.select("survey", "section", "code", "v.values")
    return cbk.open_text(rows)


def cbk_7_summary(spark, d):
    return cbk.label_summary(cbk.label_review(parts.codebook(spark, d)[1]))


def cbk_8_alignment(spark, d):
    """Codes that order lines hold against those of the codebook's first wave."""
    data = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"))
    return cbk.alignment(data, parts.codebook(spark, d)[0].where("survey = 'w0'"))


def cbk_10_compare(spark, d):
    variables = parts.codebook(spark, d)[0]
    return cbk.compare_versions(variables.where("survey = 'w0'"), variables.where("survey = 'w1'"))


def records(spark, d) -> DataFrame:
    """Scales with an adjusted form, which differs between variables of the same scale: every third keeps its labels."""
    variables, values = parts.codebook(spark, d)
    rows = cbk.scales(variables, values, collapsed())
    return rows.withColumn("adjusted", F.when(F.col("pos") % 3 == 0, F.col("scale")).otherwise(F.col("adjusted")))


def cbk_11_scale_key(spark, d):
    return records(spark, d).select("survey", "code", F.md5("scale").alias("scale"))


def cbk_12_mapping(spark, d):
    return cbk.scale_mapping(records(spark, d)).select(F.md5("scale").alias("scale"), "mapped")


def cbk_12_conflicts(spark, d):
    return cbk.scale_conflicts(records(spark, d)).select("survey", "code")


def cbk_13_apply(spark, d):
    """The mapping of the first wave applied to the second."""
    rows = records(spark, d)
    done = cbk.apply_mapping(rows.where("survey = 'w1'"), cbk.scale_mapping(rows.where("survey = 'w0'")))
    return done.select("code", "adjusted", "was_mapped")


def cbk_14_collapse(spark, d):
    return parts.codebook(spark, d)[1].groupBy(collapsed().alias("label")).agg(F.count(F.lit(1)).alias("n"))


def cbk_15_enrich(spark, d):
    """A stand-in for a service: it fails at first on codes that hold a 7, and gives the question in upper case."""
    variables = parts.codebook(spark, d)[0].where("question is not null").select("var_pos", "code", "question")

    def service(batch):
        again = batch["code"].str.contains("7") & ~batch["code"].str.contains("77")
        return batch.assign(enriched=batch["question"].str.upper(), failed=again)

    done = cbk.enrich(variables, service, "enriched string", "var_pos", skip=3)
    return done.select("var_pos", "enriched", "failed", "retried")


def cbk_15_random(spark, d):
    """A stand-in for a service that fails by chance, four calls in ten, whatever the row: each variable comes once all the same."""
    variables = parts.codebook(spark, d)[0].where("question is not null").select("var_pos", "question")

    def service(batch):
        return batch.assign(enriched=batch["question"].str.upper(), failed=np.random.default_rng().random(len(batch)) < 0.4)

    return cbk.enrich(variables, service, "enriched string", "var_pos", attempts=60, parts=2).select("var_pos", "enriched", "failed")


def cbk_16_category(spark, d):
    return parts.codebook(spark, d)[0].groupBy(cbk.closed_category(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def cbk_17_clean(spark, d):
    variables = parts.codebook(spark, d)[0]
    shown = cbk.clean_enriched(F.col("category"), F.col("question"))
    notes = F.when(F.col("var_pos") % 3 == 0, " None ").when(F.col("var_pos") % 3 == 1, "no change").otherwise(F.col("brand"))
    return variables.select("var_pos", shown.alias("question"), cbk.clean_notes(notes).alias("notes"))


def src_11_chunks(spark, d):
    return cbk.pack_chunks(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text", CHUNK)


def src_12_merge(spark, d):
    variables = parts.codebook(spark, d)[0].withColumn("chunk", F.col("var_pos") % 10)
    return cbk.merge_chunks(variables).select("survey", "section", "code", "chunk")


def vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("code"), "embedding").dropDuplicates(["code"])
    return rows.where("code % 50 = 0"), rows


def sim_1_texts(spark, d):
    return sim.question_text(parts.codebook(spark, d)[0])


def sim_2_embed(spark, d):
    """Vectors by hashed words of every question; their sums count the words."""
    rows = sim.embed(sim.question_text(parts.codebook(spark, d)[0]), sim.hashed_words)
    return rows.select("code", "text", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).cast("long").alias("n_words"))


def sim_2_weighted(spark, d):
    """The default vectors of questions: each entry's position and value where it isn't zero."""
    rows = sim.embed(sim.question_text(parts.codebook(spark, d)[0]).dropDuplicates(["code", "text"]))
    each = rows.select("code", "text", F.posexplode("embedding").alias("position", "value")).where("value <> 0")
    return each.select("code", F.md5("text").alias("text"), F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


def sim_3_exclusions(spark, d):
    found = sim.exclusions(sim.similarities(*vectors(spark, d)), 0.3)
    return found.select(F.col("target_code").alias("target"), F.array_join("excluded", "|").alias("excluded"))


def sim_4_scores(spark, d):
    targets, features = vectors(spark, d)
    return sim.similarities(targets.where("code = 0"), features).select("target", "feature", F.round("similarity", 5).alias("similarity"))


def sim_5_report(spark, d):
    return sim.nearest_features(*vectors(spark, d), 5, 0.3).select("target", "rank", "feature", "excluded")


def sim_6_keywords(spark, d):
    texts = sim.question_text(parts.codebook(spark, d)[0]).dropDuplicates(["code", "text"])
    return sim.keyword_leakage(texts.where("code rlike '^P[0-9]*77$'"), texts.where("code rlike '[13]$'"))


def sim_7_counts(spark, d):
    return sim.exclusion_counts(sim.similarities(*vectors(spark, d)), 0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cln_4_normalise, cln_5_apostrophes, cln_6_category_key, cln_7_deny_list, cln_8_nested, cln_10_base_name, cbk_1_structure, cbk_1_files, cbk_2_artifacts, cbk_2_documents, cbk_3_severity, cbk_4_statistics,
        cbk_5_recommendations, cbk_7_labels, cbk_7_open_text, cbk_7_summary, cbk_8_alignment, cbk_10_compare, cbk_11_scale_key, cbk_12_mapping, cbk_12_conflicts, cbk_13_apply, cbk_14_collapse, cbk_15_enrich, cbk_15_random, cbk_16_category,
        cbk_17_clean, src_11_chunks, src_12_merge, sim_1_texts, sim_2_embed, sim_2_weighted, sim_3_exclusions, sim_4_scores, sim_5_report, sim_6_keywords, sim_7_counts,
    )
}


def oracles() -> dict[str, str]:
    with_ = parts.oracle_ctes()
    listed = lambda xs: ", ".join(map(quoted, xs))
    norm = f"CASE WHEN trim(label) IN ({listed(cbk.STARRED)}) THEN regexp_replace(trim(label), '\\*$', '') ELSE trim(label) END"
    straight = lambda c: f"translate({c}, '’‘', '''''')"
    key = "CASE WHEN coalesce(length(category), 0) = 0 THEN 'other' ELSE translate(lower(trim(category)), '/ ', '__') END"
    rules = "rules(t, n, p) AS (VALUES " + ", ".join(f"({quoted(t)}, {quoted(n)}, {quoted(p)})" for t, n, p in art.PATTERNS) + ")"
    sev = f"CASE WHEN pattern_name IN ({listed(art.CRITICAL)}) THEN 'critical' WHEN pattern_name IN ({listed(art.WARNING)}) THEN 'warning' ELSE 'info' END"
    sug = "CASE pattern_name " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in art.SUGGESTIONS.items()) + f" ELSE {quoted(art.OTHERWISE)} END"
    found = f"""{with_}, {rules}, texts AS (SELECT survey, code, 'description' AS field, description AS text FROM part_vars UNION ALL SELECT survey, code, 'question', question FROM part_vars WHERE length(question) >= 10
        UNION ALL SELECT survey, code, 'values[' || raw || ']', label FROM part_vals),
hits AS (SELECT survey, code, field, t AS type, n AS pattern_name, unnest(regexp_extract_all(text, p, 0, 'i')) AS matched FROM texts, rules
   UNION ALL SELECT survey, code, 'value_code[' || raw || ']', t, n, unnest(regexp_extract_all(raw, p, 0, 'i')) FROM part_vals, rules WHERE t = 'special_values'),
found AS (SELECT *, {sev} AS severity, {sug} AS suggestion FROM hits)"""
    review = f"""{with_}, review AS (SELECT survey, code, count(*) AS n_options, bool_or(coalesce(regexp_matches(lower(label), {quoted('|'.join(cbk.REVIEW_MISSING))}), false)) AS has_missing,
        bool_or(coalesce(regexp_matches(lower(label), {quoted('|'.join(cbk.REVIEW_SCALE))}), false)) AS is_scale,
        CASE WHEN count(DISTINCT label) > 10 AND bool_or(regexp_matches(lower(label), {quoted('|'.join(cbk.REVIEW_SCALE))})) THEN 'long_scale' WHEN count(*) FILTER (WHERE regexp_matches(trim(label), '^[0-9]+$')) > 2 THEN 'numeric_labels' END AS issue
        FROM part_vals GROUP BY 1, 2)"""
    k = "TRY_CAST(raw AS INT)"
    coll = f"CASE WHEN {k} BETWEEN 0 AND 1 THEN 'Strongly disagree' WHEN {k} BETWEEN 2 AND 3 THEN 'Somewhat disagree' WHEN {k} BETWEEN 4 AND 6 THEN 'Neither disagree nor agree' WHEN {k} BETWEEN 7 AND 8 THEN 'Somewhat agree' WHEN {k} BETWEEN 9 AND 10 THEN 'Strongly agree' ELSE {norm} END"
    recs = f"""{with_}, recs AS (SELECT s.survey, s.code, pos, scale, CASE WHEN pos % 3 = 0 THEN scale ELSE adjusted END AS adjusted FROM (SELECT survey, code, min(var_pos) AS pos FROM part_vars GROUP BY ALL) p
        JOIN (SELECT survey, code, string_agg(raw || '=' || label, ';' ORDER BY raw, label) AS scale, string_agg(raw || '=' || new, ';' ORDER BY raw, new) AS adjusted FROM (SELECT *, {coll} AS new FROM part_vals) GROUP BY ALL) s ON s.survey = p.survey AND s.code = p.code),
mapping AS (SELECT scale, arg_min(adjusted, pos) AS mapped FROM recs GROUP BY scale)"""
    files = f"""{with_}, f AS (SELECT * REPLACE (survey || '/' || var_pos // {FILE} AS survey), var_pos // {FILE} AS block, var_pos % {FAULTS} AS k FROM part_vars),
        live AS (SELECT * FROM f WHERE block % 10 <> 9), objs AS (SELECT * FROM live WHERE length(section) % 7 <> 0)"""
    vec = "WITH v AS (SELECT vec_id AS code, any_value(embedding)::DOUBLE[] AS e FROM embeddings GROUP BY 1), s AS (SELECT t.code AS target, f.code AS feature, CASE WHEN list_dot_product(t.e, t.e) > 0 AND list_dot_product(f.e, f.e) > 0 THEN list_cosine_similarity(t.e, f.e) END AS similarity FROM v t, v f WHERE t.code % 50 = 0 AND f.code % 50 <> 0)"
    text = "coalesce(question, description, code)"
    words = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 4), lambda w: regexp_replace(w, '^[?.,!]+|[?.,!]+$', '', 'g')))"
    return {
        "cln_4_normalise": f"{with_} SELECT survey, code, raw, {norm} AS label FROM part_vals",
        "cln_5_apostrophes": f"{with_} SELECT {straight('t')} AS text, count(*) AS n FROM (SELECT question AS t FROM part_vars UNION ALL SELECT label FROM part_vals) GROUP BY 1",
        "cln_6_category_key": f"{with_} SELECT {key} AS key, count(*) AS n FROM part_vars GROUP BY 1",
        "cln_7_deny_list": f"{with_} SELECT survey, code, var_pos FROM part_vars WHERE code NOT IN (SELECT code FROM part_vals GROUP BY code HAVING count(*) < 10)",
        "cln_8_nested": rf"""{with_}, odd AS (SELECT * REPLACE (CASE WHEN code LIKE '%7' THEN code || '"\' || chr(10) || '/' ELSE code END AS code) FROM part_vars),
            last AS (SELECT survey, section, code, max(var_pos) AS pos, arg_max(row(question, description), var_pos) AS v FROM odd GROUP BY ALL),
            labels AS (SELECT survey, CASE WHEN code LIKE '%7' THEN code || '"\' || chr(10) || '/' ELSE code END AS code, string_agg(to_json(raw) || ':' || to_json(label), ',' ORDER BY label_pos, raw) AS l FROM part_vals GROUP BY 1, 2)
            SELECT survey, section, '{{' || string_agg(to_json(code) || ':{{"question":' || coalesce(to_json(v[1]), 'null') || ',"description":' || coalesce(to_json(v[2]), 'null') || ',"values":{{' || coalesce(l, '') || '}}}}', ',' ORDER BY pos, code) || '}}' AS variables
            FROM last LEFT JOIN labels USING (survey, code) GROUP BY 1, 2""",
        "cln_10_base_name": f"{with_} SELECT survey, code, regexp_replace(code, '_[0-9]+$', '') AS base FROM part_vars",
        "cbk_1_structure": f"""{with_} SELECT survey, code, 'no_question' AS problem, 'critical' AS severity FROM part_vars WHERE question IS NULL UNION ALL SELECT survey, code, 'no_description', 'critical' FROM part_vars WHERE description IS NULL
            UNION ALL SELECT survey, code, 'short_question', 'warning' FROM part_vars WHERE length(question) < 10 UNION ALL SELECT survey, code, 'no_values', 'warning' FROM part_vars v WHERE NOT EXISTS (SELECT 1 FROM part_vals x WHERE x.survey = v.survey AND x.code = v.code)
            UNION ALL SELECT survey, code, 'duplicate_code', 'critical' FROM part_vars GROUP BY 1, 2 HAVING count(*) > 1""",
        "cbk_1_files": f"""{files}
            SELECT DISTINCT survey, NULL AS section, NULL AS code, 'file_not_object' AS problem, 'critical' AS severity FROM f WHERE block % 10 = 9
            UNION ALL SELECT DISTINCT survey, NULL, NULL, 'non_string_key', 'warning' FROM objs WHERE k = 6 UNION ALL SELECT DISTINCT survey, 'extra', NULL, 'duplicate_section', 'critical' FROM live WHERE block % 3 = 0
            UNION ALL SELECT DISTINCT survey, section, NULL, 'section_not_object', 'critical' FROM live WHERE length(section) % 7 = 0 UNION ALL SELECT survey, NULL, code, 'duplicate_code', 'critical' FROM objs GROUP BY survey, code HAVING count(*) > 1
            UNION ALL SELECT survey, section, code, 'variable_not_object', 'critical' FROM objs WHERE k = 0 UNION ALL SELECT survey, section, code, 'missing_question', 'critical' FROM objs WHERE k = 1
            UNION ALL SELECT survey, section, code, 'missing_values', 'critical' FROM objs WHERE k = 7 UNION ALL SELECT survey, section, code, 'description_not_string', 'warning' FROM objs WHERE k = 7
            UNION ALL SELECT survey, section, code, 'question_not_string', 'warning' FROM objs WHERE k = 4 UNION ALL SELECT survey, section, code, 'values_not_object', 'critical' FROM objs WHERE k = 2
            UNION ALL SELECT survey, section, code, 'empty_values', 'warning' FROM objs WHERE k = 3 UNION ALL SELECT survey, section, code, 'repeated_value_code', 'warning' FROM objs WHERE k = 5
            UNION ALL SELECT survey, section, code, 'short_question', 'warning' FROM objs WHERE k = 8 OR k NOT IN (0, 1, 4) AND length(question) < 10""",
        "cbk_7_open_text": f"{files} SELECT survey, section, code, 'String variable' AS kind FROM objs WHERE k = 2",
        "cbk_15_random": f"{with_} SELECT var_pos, upper(question) AS enriched, false AS failed FROM part_vars WHERE question IS NOT NULL",
        "cbk_2_artifacts": f"{found} SELECT survey, code, field, type, pattern_name, matched, count(*) AS n FROM found GROUP BY ALL",
        "cbk_2_documents": f"WITH {rules}, hits AS (SELECT doc_id, t, n, unnest(regexp_extract_all(text, p, 0, 'i')) AS m FROM documents, rules) SELECT t AS type, n AS pattern_name, count(*) AS n_matches, count(DISTINCT doc_id) AS n_documents FROM hits GROUP BY ALL",
        "cbk_3_severity": f"{found} SELECT pattern_name, severity, suggestion, count(*) AS n FROM found GROUP BY ALL",
        "cbk_4_statistics": f"""{found} SELECT survey, 'variables' AS measure, 'all' AS value, count(*) AS n FROM part_vars GROUP BY 1 UNION ALL SELECT survey, 'section', section, count(*) FROM part_vars GROUP BY 1, 3
            UNION ALL SELECT survey, 'value_codes', 'all', count(*) FROM part_vals GROUP BY 1 UNION ALL SELECT survey, 'sections', 'all', count(DISTINCT section) FROM part_vars GROUP BY 1
            UNION ALL SELECT survey, 'pattern', pattern_name, count(*) FROM found GROUP BY 1, 3 UNION ALL SELECT survey, 'severity', severity, count(*) FROM found GROUP BY 1, 3 UNION ALL SELECT survey, 'type', type, count(*) FROM found GROUP BY 1, 3""",
        "cbk_5_recommendations": f"""{found} SELECT DISTINCT survey, CASE type WHEN 'placeholders' THEN 'placeholder_filling' WHEN 'interviewer_instructions' THEN 'instruction_removal' WHEN 'binary_marking' THEN 'value_label_cleaning' WHEN 'scale_abbreviations' THEN 'value_label_cleaning'
            WHEN 'skip_logic' THEN 'question_reformulation' ELSE 'code_handling' END AS kind, CASE type WHEN 'placeholders' THEN code || ': Replace ''' || matched || ''' - ' || suggestion WHEN 'interviewer_instructions' THEN code || ': Remove ''' || matched || ''''
            WHEN 'skip_logic' THEN code || ': Remove routing logic ''' || matched || '''' WHEN 'binary_marking' THEN code || ': Convert ''' || matched || ''' to natural language' WHEN 'scale_abbreviations' THEN code || ': Convert ''' || matched || ''' to natural language'
            ELSE code || ': Handle special code ''' || matched || '''' END AS advice FROM found WHERE type IN ('placeholders', 'interviewer_instructions', 'binary_marking', 'scale_abbreviations', 'skip_logic', 'response_codes', 'special_values')""",
        "cbk_7_labels": f"{review} SELECT * FROM review",
        "cbk_7_summary": f"{review} SELECT survey, count(*) AS n_variables, count(*) FILTER (WHERE has_missing) AS n_with_missing, count(*) FILTER (WHERE is_scale) AS n_scales, min(n_options) AS min_options, max(n_options) AS max_options, median(n_options) AS median_options, count(issue) AS n_issues FROM review GROUP BY 1",
        "cbk_8_alignment": f"""{with_}, a AS (SELECT DISTINCT 'P' || l_partkey AS code FROM lineitem), b AS (SELECT DISTINCT code FROM part_vars WHERE survey = 'w0'), j AS (SELECT a.code AS x, b.code AS y FROM a FULL JOIN b ON a.code = b.code)
            SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) FILTER (WHERE y IS NULL) AS n_data_only, count(*) FILTER (WHERE x IS NULL) AS n_codebook_only, round(100.0::DOUBLE * count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(y), 4) AS overlap FROM j""",
        "cbk_10_compare": f"""{with_}, a AS (SELECT code, array_to_string(list_sort(list(DISTINCT section)), '|') AS s FROM part_vars WHERE survey = 'w0' GROUP BY 1), b AS (SELECT code, array_to_string(list_sort(list(DISTINCT section)), '|') AS s FROM part_vars WHERE survey = 'w1' GROUP BY 1),
            j AS (SELECT coalesce(a.code, b.code) AS code, a.s AS sections_a, b.s AS sections_b FROM a FULL JOIN b ON a.code = b.code)
            SELECT code, CASE WHEN sections_b IS NULL THEN 'only_a' WHEN sections_a IS NULL THEN 'only_b' ELSE 'common' END AS state, sections_a, sections_b,
            regexp_replace(code, '_[0-9]+$', '') IN (SELECT regexp_replace(code, '_[0-9]+$', '') FROM a) AND regexp_replace(code, '_[0-9]+$', '') IN (SELECT regexp_replace(code, '_[0-9]+$', '') FROM b) AS base_known FROM j""",
        "cbk_11_scale_key": f"{recs} SELECT survey, code, md5(scale) AS scale FROM recs",
        "cbk_12_mapping": f"{recs} SELECT md5(scale) AS scale, mapped FROM mapping",
        "cbk_12_conflicts": f"{recs} SELECT survey, code FROM recs JOIN mapping USING (scale) WHERE adjusted <> mapped",
        "cbk_13_apply": f"{recs}, first AS (SELECT scale, arg_min(adjusted, pos) AS mapped FROM recs WHERE survey = 'w0' GROUP BY 1) SELECT code, coalesce(mapped, adjusted) AS adjusted, mapped IS NOT NULL AS was_mapped FROM recs LEFT JOIN first USING (scale) WHERE survey = 'w1'",
        "cbk_14_collapse": f"{with_} SELECT {coll} AS label, count(*) AS n FROM part_vals GROUP BY 1",
        "cbk_15_enrich": f"""{with_}, r AS (SELECT *, contains(code, '7') AND NOT contains(code, '77') AS bad, row_number() OVER (ORDER BY var_pos) AS k FROM part_vars WHERE question IS NOT NULL)
            SELECT var_pos, upper(question) AS enriched, bad AS failed, bad AS retried FROM r WHERE k > 3""",
        "cbk_16_category": f"{with_} SELECT CASE WHEN lower(trim(category)) IN ({listed(cbk.CATEGORIES)}) THEN lower(trim(category)) ELSE 'other' END AS category, count(*) AS n FROM part_vars GROUP BY 1",
        "cbk_17_clean": f"{with_} SELECT var_pos, coalesce(nullif(trim(category), ''), question) AS question, CASE var_pos % 3 WHEN 2 THEN brand ELSE '' END AS notes FROM part_vars",
        "src_11_chunks": f"""WITH RECURSIVE p AS (SELECT conv_id AS doc, turn, length(coalesce(text, ''))::INT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS k FROM conversations),
            f(doc, k, chunk, first, last, n_pages, n_chars) AS (SELECT doc, k, 0, turn, turn, 1, n FROM p WHERE k = 1
              UNION ALL SELECT p.doc, p.k, CASE WHEN f.n_chars + p.n > {CHUNK} AND f.n_chars > 0 THEN chunk + 1 ELSE chunk END, CASE WHEN f.n_chars + p.n > {CHUNK} AND f.n_chars > 0 THEN p.turn ELSE first END, p.turn,
                CASE WHEN f.n_chars + p.n > {CHUNK} AND f.n_chars > 0 THEN 1 ELSE n_pages + 1 END, CASE WHEN f.n_chars + p.n > {CHUNK} AND f.n_chars > 0 THEN p.n ELSE n_chars + p.n END FROM f JOIN p ON p.doc = f.doc AND p.k = f.k + 1)
            SELECT doc, chunk, arg_max(first, k) AS first, arg_max(last, k) AS last, arg_max(n_pages, k) AS n_pages, arg_max(n_chars, k) AS n_chars FROM f GROUP BY doc, chunk""",
        "src_12_merge": f"{with_} SELECT survey, section, code, max(var_pos % 10) AS chunk FROM part_vars GROUP BY 1, 2, 3",
        "sim_1_texts": f"{with_} SELECT code, {text} AS text FROM part_vars",
        "sim_2_embed": f"{with_} SELECT code, {text} AS text, len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) AS n_words FROM part_vars",
        "sim_2_weighted": f"""{with_}, t AS (SELECT DISTINCT code, {text} AS text FROM part_vars), w AS (SELECT code, text, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM t),
            b AS (SELECT code, text, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS position, count(*) AS n FROM w GROUP BY ALL), f AS (SELECT position, count(*) AS df FROM b GROUP BY 1)
            SELECT code, md5(text) AS text, position, round(n * ln(((SELECT count(*) FROM t) + 1) / (df + 1)), 6) AS value FROM b JOIN f USING (position) WHERE df < (SELECT count(*) FROM t)""",
        "sim_3_exclusions": f"{vec} SELECT target, string_agg(feature, '|' ORDER BY feature) AS excluded FROM s WHERE similarity >= 0.3 GROUP BY 1",
        "sim_4_scores": f"{vec} SELECT target, feature, round(similarity, 5) AS similarity FROM s WHERE target = 0 UNION ALL SELECT t.code, f.code, round(CASE WHEN list_dot_product(f.e, f.e) > 0 THEN list_cosine_similarity(t.e, f.e) END, 5) FROM v t, v f WHERE t.code = 0 AND f.code % 50 = 0 AND f.code <> 0",
        "sim_5_report": f"{vec} SELECT target, rank::INT AS rank, feature, similarity >= 0.3 AS excluded FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, feature) AS rank FROM s WHERE similarity IS NOT NULL) WHERE rank <= 5",
        "sim_6_keywords": f"""{with_}, x AS (SELECT DISTINCT code, {text} AS text FROM part_vars), w AS (SELECT code, unnest({words}) AS word FROM x)
            SELECT t.code AS target, f.code AS feature, count(*) AS n_shared FROM w t JOIN w f ON f.word = t.word WHERE regexp_matches(t.code, '^P[0-9]*77$') AND regexp_matches(f.code, '[13]$') AND NOT regexp_matches(f.code, '^P[0-9]*77$') GROUP BY 1, 2 HAVING count(*) >= 2""",
        "sim_7_counts": f"{vec} SELECT target, count(*) FILTER (WHERE similarity >= 0.3) AS n FROM s GROUP BY 1",
    }
