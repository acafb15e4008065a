"""Registered queries of answer variations, surface-form tests, prompts and evaluation, and SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answer_patterns as pat
from ..operators import evaluation as evl
from ..operators import instances as ins
from ..operators import testsets as tst
from ..operators import variations as var
from .survey_queries import instance_ctes, instances
from .testset_queries import FORMATS, items, option_ctes, ordering_ctes

SAMPLE = 300


def options(spark, d) -> DataFrame:
    return instances(spark, d).select(F.explode("options").alias("option"))


def of_type(spark, d, kind: str) -> DataFrame:
    return var.all_variations(options(spark, d)).where(F.col("type") == kind).select("option", "pos", "variation", "rule")


def var_4_synonyms(spark, d):
    return of_type(spark, d, "synonym")


def var_5_reorder(spark, d):
    return of_type(spark, d, "reorder")


def var_6_pronoun(spark, d):
    return of_type(spark, d, "pronoun")


def var_7_all(spark, d):
    return var.all_variations(options(spark, d)).select("option", "type", "variation")


def var_8_coverage(spark, d):
    return var.coverage(options(spark, d))


def var_9_substantive(spark, d):
    return instances(spark, d).select("example_id", F.array_join(var.substantive(F.col("options")), "|").alias("substantive"))


def tests(spark, d) -> DataFrame:
    return var.surface_forms(instances(spark, d))


def sft_2_option_sets(spark, d):
    shown = [F.array_join(k, "|", "-").alias(k) for k in ("original", *var.TYPES)]
    return tests(spark, d).where("reason is null").select("example_id", *shown, F.array_join(F.array_sort("rules"), "|").alias("rules"), "ground_truth_index")


def sft_4_generate(spark, d):
    return var.generate(instances(spark, d), SAMPLE).select("example_id", "has_synonym", "has_reorder", "has_pronoun")


def sft_5_statistics(spark, d):
    return var.statistics(tests(spark, d))


def smp_2_by_variation(spark, d):
    return var.sample_by_variation(tests(spark, d).where("reason is null"), SAMPLE, 7).select("example_id")


def opt_5_generate(spark, d):
    return tst.generate_options_context(instances(spark, d), 500).select("example_id", "option_type", F.array_join("conditions", "|").alias("conditions"))


def ord_3_format(spark, d):
    line = tst.ordering_text("questions", "Q: {question}\nA: {answer}")
    return instances(spark, d).select("example_id", line.alias("original"), tst.ordering_text("reversed", "{question} -> {answer}", F.reverse("questions")).alias("reversed"))


def ord_4_statistics(spark, d):
    return tst.ordering_statistics(tst.with_orderings(instances(spark, d), items()))


def fmt_11_custom(spark, d):
    own = lambda q, a: F.concat(F.upper(a), F.lit(" <- "), q)
    return instances(spark, d).select("example_id", ins.formatted(F.col("questions"), own, " / ").alias("profile"))


def fmt_12_profiles(spark, d):
    return instances(spark, d).select("example_id", *[ins.formatted(F.col("questions"), f, "\n\n").alias(f) for f in FORMATS if f != "json"])


def fmt_13_target(spark, d):
    return instances(spark, d).select("example_id", *[ins.target_text(F.col("target_question"), F.col("options"), True, k).alias(k) for k in ("list", "inline", "bullets")])


TEMPLATE = "{profile}\n=={target}==\n{options}\n{{{target_with_options}}}"


def fmt_14_template(spark, d):
    return ins.to_prompt(instances(spark, d), "bullet", template=TEMPLATE, style="inline").select("example_id", "prompt")


def fmt_15_qa(spark, d):
    return instances(spark, d).select("example_id", ins.qa_text(F.col("questions")).alias("qa"))


def evl_2_levels(spark, d):
    """Predictions that take the first option, by richness level side by side for each base_id, as wins and losses between levels."""
    from .respondent_queries import level_instances

    rows = level_instances(spark, d).withColumn("prediction", F.element_at("options", 1))
    return evl.compare_levels(rows, ["s2m1", "s3m2"]).groupBy("s2m1", "s3m2").agg(F.count(F.lit(1)).alias("n"))


def evl_3_slots(spark, d):
    return var.variants_at(tests(spark, d), F.lit(1)).where("original is not null")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        var_4_synonyms, var_5_reorder, var_6_pronoun, var_7_all, var_8_coverage, var_9_substantive, sft_2_option_sets, sft_4_generate, sft_5_statistics, smp_2_by_variation,
        opt_5_generate, ord_3_format, ord_4_statistics, fmt_11_custom, fmt_12_profiles, fmt_13_target, fmt_14_template, fmt_15_qa, evl_2_levels, evl_3_slots,
    )
}


def _values(rows: list[tuple]) -> str:
    show = lambda x: pat.quoted(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join(f"({', '.join(map(show, r))})" for r in rows) + ")"


def variation_ctes() -> str:
    """Up to ``vars_all`` (option, type, pos, variation, rule), from ``instance_ctes``."""
    inst = instance_ctes()[1] + ", ins AS (SELECT base_id || '_s3m2' AS example_id, 'star' AS survey, inst.* FROM inst)"
    flat = lambda rules: [(k, v, r, i) for k, own in rules.items() for i, (v, r) in enumerate(own)]
    special = ", ".join(map(pat.quoted, pat.SPECIAL))
    word = lambda w: rf"'\b' || {w} || '\b'"
    return f"""{inst},
opt_all AS (SELECT DISTINCT unnest(options) AS option FROM ins),
ok AS (SELECT option FROM opt_all WHERE lower(trim(option)) NOT IN ({special}) AND NOT regexp_matches(lower(option), {pat.quoted(pat.OPTION_RE)})),
phr(k, variation, rule, i) AS {_values(flat(var.phrase_rules()))},
wrd(a, b, i) AS {_values([(a, b, i) for i, (a, b) in enumerate(var.WORDS)])},
reo(k, variation, rule, i) AS {_values(flat(var.reorder_rules()))},
pro(k, variation, rule, i) AS {_values(flat(var.pronoun_rules()))},
raw_vars AS (
  SELECT option, 'synonym' AS type, i, variation, rule FROM ok JOIN phr ON k = lower(option)
  UNION ALL SELECT option, 'synonym', 1000 + i, variation, rule FROM (SELECT option, i,
      CASE WHEN regexp_matches(option, {word('a')}, 'i') THEN regexp_replace(option, {word('a')}, b, 'gi') WHEN regexp_matches(option, {word('b')}, 'i') THEN regexp_replace(option, {word('b')}, a, 'gi') END AS variation,
      CASE WHEN regexp_matches(option, {word('a')}, 'i') THEN '''' || a || ''' -> ''' || b || '''' ELSE '''' || b || ''' -> ''' || a || '''' END AS rule FROM ok, wrd) WHERE variation <> option
  UNION ALL SELECT option, 'reorder', i, variation, rule FROM ok JOIN reo ON k = lower(option)
  UNION ALL SELECT option, 'pronoun', i, variation, rule FROM ok JOIN pro ON k = lower(option)),
vars_all AS (SELECT option, type, row_number() OVER (PARTITION BY option, type ORDER BY i) - 1 AS pos, variation, rule
             FROM (SELECT *, row_number() OVER (PARTITION BY option, type, variation ORDER BY i) AS r FROM raw_vars) WHERE r = 1)"""


def surface_ctes() -> str:
    """Up to ``sft`` (example_id, survey, reason, original, the sets, rules, has_*, gt)."""
    special = ", ".join(map(pat.quoted, pat.SPECIAL))
    slot = lambda k: f"list(max_v ORDER BY idx) FILTER (WHERE type = '{k}') AS {k}"
    return f"""{variation_ctes()},
kept AS (SELECT *, list_filter(options, lambda o: lower(trim(o)) NOT IN ({special})) AS kept FROM ins),
elig AS (SELECT *, CASE WHEN len(options) < 2 THEN 'insufficient_options' WHEN len(kept) < 2 THEN 'all_special_values' WHEN regexp_matches(lower(target_question), {pat.quoted(pat.QUESTION_RE)}) THEN 'ineligible_question_pattern'
         WHEN len(list_filter(kept, lambda o: regexp_matches(lower(o), {pat.quoted(pat.OPTION_RE)}))) > 0 THEN 'ineligible_option_content' END AS reason FROM kept),
lists AS (SELECT DISTINCT options, kept FROM elig),
slots AS (SELECT options, unnest(range(len(kept))) AS idx, unnest(kept) AS o, kept FROM lists),
typed AS (SELECT s.*, t.type, CASE WHEN NOT list_contains(s.kept[s.idx + 2:], s.o) THEN v.variation END AS max_v, CASE WHEN NOT list_contains(s.kept[s.idx + 2:], s.o) THEN v.rule END AS rule
          FROM slots s CROSS JOIN (VALUES ('synonym'), ('reorder'), ('pronoun')) t(type) LEFT JOIN vars_all v ON v.option = s.o AND v.type = t.type AND v.pos = 0),
sets AS (SELECT options, {slot('synonym')}, {slot('reorder')}, {slot('pronoun')}, list(type || '_' || idx || ': ' || rule) FILTER (WHERE rule IS NOT NULL) AS rules FROM typed GROUP BY options),
sft AS (SELECT e.example_id, e.survey, e.reason, e.kept AS original, s.synonym, s.reorder, s.pronoun, coalesce(s.rules, []) AS rules, coalesce(list_position(e.kept, e.answer), 0) - 1 AS gt,
        reason IS NULL AND len(list_filter(s.synonym, lambda x: x IS NOT NULL)) > 0 AS has_synonym, reason IS NULL AND len(list_filter(s.reorder, lambda x: x IS NOT NULL)) > 0 AS has_reorder,
        reason IS NULL AND len(list_filter(s.pronoun, lambda x: x IS NOT NULL)) > 0 AS has_pronoun FROM elig e JOIN sets s ON s.options = e.options)"""


def _sampled(seed: int, n: int, where: str) -> str:
    """A sample by variation as common table expressions after ``sft``, up to ``chosen``."""
    key, most = f"md5('{seed}|' || example_id), example_id", min(50, n // 6)
    steps, before = [], []
    for k in ("pronoun", "reorder", "synonym"):
        gone = "".join(f" AND example_id NOT IN (SELECT example_id FROM t_{b})" for b in before)
        steps.append(f"t_{k} AS (SELECT example_id FROM base WHERE has_{k}{gone} ORDER BY {key} LIMIT {most})")
        before.append(k)
    taken = " UNION ALL ".join(f"SELECT example_id FROM t_{k}" for k in before)
    return f"""base AS (SELECT * FROM sft WHERE {where}), {', '.join(steps)}, taken AS ({taken}),
chosen AS (SELECT example_id FROM (SELECT example_id, 0 AS late FROM taken UNION ALL SELECT example_id, 1 FROM base WHERE example_id NOT IN (SELECT example_id FROM taken)) ORDER BY late, {key} LIMIT {n})"""


def oracles() -> dict[str, str]:
    from .respondent_queries import level_instance_ctes

    v, s, inst = variation_ctes(), surface_ctes(), instance_ctes()[1] + ", ins AS (SELECT base_id || '_s3m2' AS example_id, inst.* FROM inst)"
    special = ", ".join(map(pat.quoted, pat.SPECIAL))
    one = lambda k: f"{v} SELECT option, pos, variation, rule FROM vars_all WHERE type = '{k}'"
    show = lambda k: f"array_to_string(list_transform({k}, lambda x: coalesce(x, '-')), '|') AS {k}"
    lines = {
        "qa": "'Q: ' || q || chr(10) || 'A: ' || a", "interview": "'Interviewer: ' || q || chr(10) || 'Respondent: ' || a", "bullet": "'- ' || q || ': ' || a", "colon": "q || ': ' || a", "arrow": "q || ' → ' || a",
        "brackets": "'[' || q || '] ' || a", "xml": "'<question>' || q || '</question>' || chr(10) || '<answer>' || a || '</answer>'", "narrative": """'When asked "' || q || '", they answered "' || a || '".'""", "card": "q || ' | ' || a",
    }
    # A question holds no '=', so an item parts at its first one.
    def line(x: str, sep: str, source: str = "string_split(questions, '|')") -> str:
        q, a = "split_part(z, '=', 1)", "substr(z, position('=' IN z) + 1)"
        out = " || ".join({"q": q, "a": a, "upper(a)": f"upper({a})"}.get(p, p) for p in x.split(" || "))
        return f"array_to_string(list_transform({source}, lambda z: {out}), {sep})"

    nl = "chr(10) || chr(10)"
    numbered = "array_to_string(list_transform(options, lambda o, i: i || '. ' || o), chr(10))"
    order = ordering_ctes()
    opt = option_ctes()
    return {
        "var_4_synonyms": one("synonym"), "var_5_reorder": one("reorder"), "var_6_pronoun": one("pronoun"),
        "var_7_all": f"{v} SELECT option, type, variation FROM vars_all",
        "var_8_coverage": f"""{v} SELECT (SELECT count(*) FROM opt_all) AS n_options, count(DISTINCT option) FILTER (WHERE type = 'synonym') AS synonym, count(DISTINCT option) FILTER (WHERE type = 'reorder') AS reorder,
            count(DISTINCT option) FILTER (WHERE type = 'pronoun') AS pronoun, count(DISTINCT option) AS any_type FROM vars_all""",
        "var_9_substantive": f"{inst} SELECT example_id, array_to_string(list_filter(options, lambda o: lower(trim(o)) NOT IN ({special})), '|') AS substantive FROM ins",
        "sft_2_option_sets": f"{s} SELECT example_id, {show('original')}, {show('synonym')}, {show('reorder')}, {show('pronoun')}, array_to_string(list_sort(rules), '|') AS rules, gt AS ground_truth_index FROM sft WHERE reason IS NULL",
        "sft_4_generate": f"{s}, {_sampled(42, SAMPLE, 'reason IS NULL AND (has_synonym OR has_reorder OR has_pronoun)')} SELECT example_id, has_synonym, has_reorder, has_pronoun FROM sft WHERE example_id IN (SELECT example_id FROM chosen)",
        "sft_5_statistics": f"""{s} SELECT 'processed' AS measure, 'all' AS value, count(*) AS n FROM sft UNION ALL SELECT 'eligibility', coalesce(reason, 'eligible'), count(*) FROM sft GROUP BY 2
            UNION ALL SELECT 'survey', survey, count(*) FROM sft GROUP BY 2 UNION ALL SELECT 'slots', 'all', sum(CASE WHEN reason IS NULL THEN len(original) ELSE 0 END)::BIGINT FROM sft
            {' '.join(f"UNION ALL SELECT 'filled', '{k}', sum(CASE WHEN reason IS NULL THEN len(list_filter({k}, lambda x: x IS NOT NULL)) ELSE 0 END)::BIGINT FROM sft UNION ALL SELECT 'with_variation', '{k}', count(*) FILTER (WHERE has_{k}) FROM sft" for k in var.TYPES)}""",
        "smp_2_by_variation": f"{s}, {_sampled(7, SAMPLE, 'reason IS NULL')} SELECT example_id FROM chosen",
        "opt_5_generate": f"""{opt}, r AS (SELECT example_id, option_type, row_number() OVER (PARTITION BY option_type ORDER BY md5('42|' || example_id), example_id) AS r FROM opts4 WHERE reason IS NULL)
            SELECT example_id, option_type, CASE WHEN option_type = 'scale' THEN 'hidden|shown_natural|shown_reversed' ELSE 'hidden|shown_natural' END AS conditions
            FROM r ORDER BY CASE WHEN r > 166 THEN 2 WHEN option_type = 'scale' THEN 0 ELSE 1 END, md5('42|' || example_id), example_id LIMIT 500""",
        "ord_3_format": f"""{inst} SELECT example_id, {line("'Q: ' || q || chr(10) || 'A: ' || a", 'chr(10)')} AS original, {line("q || ' -> ' || a", 'chr(10)', "list_reverse(string_split(questions, '|'))")} AS reversed FROM ins""",
        "ord_4_statistics": f"""{order} SELECT 'processed' AS measure, 'all' AS value, count(*) AS n FROM ins UNION ALL SELECT 'eligible', 'all', count(*) FROM fit UNION ALL SELECT 'n_features', CAST(n_features AS VARCHAR), count(*) FROM fit GROUP BY 2
            UNION ALL SELECT 'orderings', 'all', count(*) FROM ord UNION ALL SELECT 'n_orderings', CAST(k AS VARCHAR), count(*) FROM (SELECT example_id, count(*) AS k FROM ord GROUP BY 1) GROUP BY 2""",
        "fmt_11_custom": f"""{inst} SELECT example_id, {line("upper(a) || ' <- ' || q", "' / '")} AS profile FROM ins""",
        "fmt_12_profiles": f"{inst} SELECT example_id, {', '.join(f'{line(x, nl)} AS {k}' for k, x in lines.items())} FROM ins",
        "fmt_13_target": f"""{inst} SELECT example_id, target_question || {nl} || 'Options:' || chr(10) || {numbered} AS list, target_question || {nl} || 'Options: ' || array_to_string(options, ', ') AS inline,
            target_question || {nl} || 'Options:' || chr(10) || array_to_string(list_transform(options, lambda o: '• ' || o), chr(10)) AS bullets FROM ins""",
        "fmt_14_template": f"""{inst} SELECT example_id, {line("'- ' || q || ': ' || a", 'chr(10)')} || chr(10) || '==' || target_question || '==' || chr(10) || {numbered} || chr(10) || '{{' || target_question || {nl} || 'Options: ' || array_to_string(options, ', ') || '}}' AS prompt FROM ins""",
        "fmt_15_qa": f"""{inst} SELECT example_id, {line("'Q: ' || q || chr(10) || 'A: ' || a", nl)} AS qa FROM ins""",
        "evl_2_levels": f"""{level_instance_ctes()}, p AS (SELECT base_id, max(CASE WHEN profile_type = 's2m1' THEN ok END) AS s2m1, max(CASE WHEN profile_type = 's3m2' THEN ok END) AS s3m2
            FROM (SELECT base_id, profile_type, CAST(options[1] = answer AS INT) AS ok FROM linst) GROUP BY 1) SELECT s2m1, s3m2, count(*) AS n FROM p GROUP BY 1, 2""",
        "evl_3_slots": f"{s} SELECT example_id, original[2] AS original, synonym[2] AS synonym, reorder[2] AS reorder, pronoun[2] AS pronoun FROM sft WHERE reason IS NULL",
    }
