"""Codebooks: audit, labels, versions, scales, enrichment. All keyed by ``survey``, so one job serves every survey and wave."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.artifact_patterns import CRITICAL, OTHERWISE, PATTERNS, SUGGESTIONS, WARNING
from ..functions.binding import each_of, let, measures
from ..functions.matching import needs
from ..sources.shared import shared_path, stored
from ..sources.splits import spread

# Labels that a star marks as no answer.
STARRED = ["Refusal*", "Not applicable*", "No answer*", "Don't know*", "Not available*"]
# Parts of labels that mean no answer, and that speak for a scale, in the review of labels.
REVIEW_MISSING = ["missing", "refused", "don't know", "no answer", "not asked", "not applicable"]
REVIEW_SCALE = ["strongly", "agree", "disagree", "satisfied", "trust", "important"]
# The closed list of question categories.
CATEGORIES = [
    "civic engagement", "climate change", "covid", "demographics", "economic outlook", "governance", "political affiliation", "politics", "trust in institutions",
    "trust in social groups", "other",
]


def normalise_label(label: Column) -> Column:
    """Trimmed; the star taken off labels that mean no answer."""
    own = F.trim(label)
    return F.when(own.isin(STARRED), F.regexp_replace(own, r"\*$", "")).otherwise(own)


def straighten(text: Column) -> Column:
    """Curly apostrophes as straight ones."""
    return F.translate(text, "’‘", "''")


def category_key(category: Column) -> Column:
    """'media/information sources' as 'media_information_sources'; none or empty as 'other'. A blank alone has an empty key."""
    return F.when(F.coalesce(F.length(category), F.lit(0)) == 0, "other").otherwise(F.translate(F.lower(F.trim(category)), "/ ", "__"))


def base_name(code: Column) -> Column:
    """A code without one trailing number after an underscore."""
    return F.regexp_replace(code, r"_\d+$", "")


def drop_listed(variables: DataFrame, denied: DataFrame) -> DataFrame:
    """Without the codes of a deny-list (code)."""
    return variables.join(denied.select("code").distinct(), "code", "left_anti")


def json_text(text: Column) -> Column:
    """A string as JSON writes it, with quotes."""
    listed = F.to_json(F.array(text))
    return F.coalesce(F.substring(listed, F.lit(2), F.length(listed) - 2), F.lit("null"))


def nested_json(variables: DataFrame, values: DataFrame) -> DataFrame:
    """(survey, section, variables): a section's variables as one JSON object {code: {question, description, values}}, in order; of a code or a raw value used twice the later one counts.

    Variables without a code and labels without a raw value go, absent texts are null. A section has as many variables as a questionnaire.
    """
    last = variables.where("code is not null").groupBy("survey", "section", "code").agg(F.max_by(F.struct("var_pos", "question", "description"), "var_pos").alias("v"))
    kept = values.where("raw is not null").groupBy("survey", "code", "raw").agg(F.max(F.struct("label_pos", "label")).alias("l"))
    entry = F.concat(json_text(F.col("raw")), F.lit(":"), json_text(F.col("l.label")))
    labels = kept.groupBy("survey", "code").agg(F.array_sort(F.collect_list(F.struct("l.label_pos", "raw", entry.alias("entry")))).alias("l"))
    labels = labels.select("survey", "code", F.array_join(F.transform("l", lambda x: x["entry"]), ",").alias("l"))
    own = [F.lit('{"question":'), json_text(F.col("v.question")), F.lit(',"description":'), json_text(F.col("v.description")), F.lit(',"values":{'), F.coalesce("l", F.lit("")), F.lit("}}")]
    rows = last.join(labels, ["survey", "code"], "left").withColumn("entry", F.concat(json_text(F.col("code")), F.lit(":"), *own))
    listed = rows.groupBy("survey", "section").agg(F.array_sort(F.collect_list(F.struct("v.var_pos", "code", "entry"))).alias("x"))
    return listed.select("survey", "section", F.concat(F.lit("{"), F.array_join(F.transform("x", lambda e: e["entry"]), ","), F.lit("}")).alias("variables"))


def structure(variables: DataFrame, values: DataFrame) -> DataFrame:
    """(survey, code, problem, severity): absent or short questions, absent descriptions, variables without labels, codes used twice."""
    counts = values.groupBy("survey", "code").agg(F.count(F.lit(1)).alias("__n"))
    rows = variables.join(counts, ["survey", "code"], "left")
    q = F.col("question")
    found = F.array(
        F.when(q.isNull(), F.struct(F.lit("no_question").alias("problem"), F.lit("critical").alias("severity"))),
        F.when(F.col("description").isNull(), F.struct(F.lit("no_description").alias("problem"), F.lit("critical").alias("severity"))),
        F.when(F.length(q) < 10, F.struct(F.lit("short_question").alias("problem"), F.lit("warning").alias("severity"))),
        F.when(F.col("__n").isNull(), F.struct(F.lit("no_values").alias("problem"), F.lit("warning").alias("severity"))),
    )
    each = rows.select("survey", "code", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("survey", "code", "x.problem", "x.severity")
    twice = variables.groupBy("survey", "code").count().where("count > 1").select("survey", "code", F.lit("duplicate_code").alias("problem"), F.lit("critical").alias("severity"))
    return each.unionByName(twice)


#: Of keys without quotes.
LOOSE = {"allowUnquotedFieldNames": "true"}


def opened(text: Column) -> Column:
    """The entries of a JSON object, values as text; keys that are written twice stay twice. Null for anything else."""
    return F.map_entries(F.from_json(text, "map<string,string>", LOOSE))


def file_variables(files: DataFrame, text: str = "text") -> DataFrame:
    """(survey, section, code, t) of codebooks as raw JSON text: what stands for each code of each section that is an object."""
    sections = files.select("survey", F.explode(opened(F.col(text))).alias("e")).select("survey", F.col("e.key").alias("section"), opened(F.col("e.value")).alias("v"))
    return sections.select("survey", "section", F.explode("v").alias("e")).select("survey", "section", F.col("e.key").alias("code"), F.col("e.value").alias("t"))


def file_structure(files: DataFrame, text: str = "text") -> DataFrame:
    """(survey, section, code, problem, severity) of codebooks as raw JSON text, a file a row: what ``load_codebook`` can't show, as it reads what has the right shape.

    Critical: ``file_not_object``, ``section_not_object``, ``variable_not_object``, ``missing_<field>`` (question, description, values), ``values_not_object``, ``duplicate_code``
    (of a survey, in one section or several) and ``duplicate_section``. Warnings: ``<field>_not_string``, ``short_question``, ``empty_values``, ``repeated_value_code``
    and, of a file, ``non_string_key`` (a key without quotes). A null text is no object. An object written as a string counts as one, as ``load_codebook`` reads it.
    Whether fields are strings isn't known where a variable writes a key twice or without quotes.
    """
    said = lambda name, grade: F.struct(F.lit(name).alias("problem"), F.lit(grade).alias("severity"))
    start = files.select("survey", F.col(text).alias("t")).withColumn("s", opened(F.col("t")))
    none = F.lit(None).cast("string")
    top = start.where("s is null").select("survey", none.alias("section"), none.alias("code"), said("file_not_object", "critical").alias("x"))
    bare = F.regexp_replace("t", r'"(\\.|[^"\\])*"', '""').rlike(r'[{,]\s*[^"\s{}\[\],:]+\s*:')
    loosely = start.where(bare).select("survey", none.alias("section"), none.alias("code"), said("non_string_key", "warning").alias("x"))
    sections = start.select("survey", F.explode("s").alias("e")).select("survey", F.col("e.key").alias("section"), F.col("e.value").alias("t")).withColumn("v", opened(F.col("t")))
    twice = sections.groupBy("survey", "section").count().where("count > 1").select("survey", "section", none.alias("code"), said("duplicate_section", "critical").alias("x"))
    shapeless = sections.where("v is null").select("survey", "section", none.alias("code"), said("section_not_object", "critical").alias("x"))
    variables = file_variables(files, text)
    again = variables.groupBy("survey", "code").count().where("count > 1").select("survey", none.alias("section"), "code", said("duplicate_code", "critical").alias("x"))
    fields = F.from_json("t", "struct<question:string,description:string,values:string>", LOOSE)
    rows = variables.withColumn("o", opened(F.col("t"))).withColumn("f", fields).withColumn("r", F.expr("try_parse_json(t)"))
    rows = rows.withColumn("l", opened(F.col("f.values")))
    has = lambda name: F.exists("o", lambda e: e["key"] == name)
    kind = lambda name: F.schema_of_variant(F.try_variant_get("r", f"$.{name}", "variant"))
    codes = F.transform("l", lambda e: e["key"])
    checks = [
        *[(~has(f), said(f"missing_{f}", "critical")) for f in ("question", "description", "values")],
        *[(has(f) & (kind(f) != "STRING"), said(f"{f}_not_string", "warning")) for f in ("question", "description")],
        (F.coalesce(kind("question") == "STRING", has("question")) & (F.length("f.question") < 10), said("short_question", "warning")),
        (has("values") & F.col("l").isNull(), said("values_not_object", "critical")), (F.size("l") == 0, said("empty_values", "warning")),
        (F.size("l") > F.size(F.array_distinct(codes)), said("repeated_value_code", "warning")),
    ]
    found = F.when(F.col("o").isNull(), F.array(said("variable_not_object", "critical"))).otherwise(F.filter(F.array(*[F.when(is_so, x) for is_so, x in checks]), lambda x: x.isNotNull()))
    each = rows.select("survey", "section", "code", F.explode(found).alias("x"))
    return top.unionByName(loosely).unionByName(twice).unionByName(shapeless).unionByName(again).unionByName(each).select("survey", "section", "code", "x.*")


def severity(name: Column) -> Column:
    return F.when(name.isin(CRITICAL), "critical").when(name.isin(WARNING), "warning").otherwise("info")


def suggestion(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(SUGGESTIONS)), "map<string,string>"), name), F.lit(OTHERWISE))


def find_artifacts(texts: DataFrame, text: str = "text", only: str | Column | None = None) -> DataFrame:
    """Adds (type, pattern_name, matched) for every match of every pattern in a text, in any case; each row of the texts as often as it has matches.

    A pattern is tried on a text only if that holds the literals that every match has (``functions/matching.py``), which few texts do.
    ``only``: one group of patterns, also by row (null: all). Row-local: no shuffle, so it runs on streams and on any table with text.
    """
    rules = [{"t": t, "n": n, "p": f"(?i){p}", "most": need.most, "need": need.clauses} for t, n, p in PATTERNS for need in [needs(p)] if not isinstance(only, str) or t == only]
    given = F.from_json(F.lit(json.dumps(rules)), "array<struct<t:string,n:string,p:string,most:int,need:array<array<string>>>>")
    own = F.col(text)

    def possible(low: Column) -> Column:
        holds = lambda r: F.forall(r["need"], lambda c: F.exists(c, lambda literal: F.contains(low["text"], literal)))
        fits = lambda r: r["most"].isNull() | (low["n"] <= r["most"])
        asked = (lambda r: only.isNull() | (r["t"] == only)) if isinstance(only, Column) else (lambda r: F.lit(True))
        return F.filter(given, lambda r: asked(r) & fits(r) & holds(r))

    tried = let(F.struct(F.lower(own).alias("text"), F.length(own).alias("n")), possible)
    found = F.flatten(F.transform(tried, lambda r: F.transform(F.regexp_extract_all(own, r["p"], F.lit(0)), lambda m: F.struct(r["t"].alias("type"), r["n"].alias("pattern_name"), m.alias("matched")))))
    return each_of(texts.where(own.isNotNull()), found, "__f", "*").select(*texts.columns, "__f.*")


def codebook_artifacts(variables: DataFrame, values: DataFrame) -> DataFrame:
    """(survey, code, field, type, pattern_name, matched, severity, suggestion) over descriptions, questions of ten characters or more, labels, and raw values.

    Raw values are held against the patterns of special values alone. Variables and values are read once each.
    """
    part = lambda field, text, only=None: F.struct(field.alias("field"), text.alias("text"), F.lit(only).cast("string").alias("only"))
    shown = F.explode(F.array(part(F.lit("description"), F.col("description")), part(F.lit("question"), F.when(F.length("question") >= 10, F.col("question"))))).alias("x")
    labels = part(F.concat(F.lit("values["), "raw", F.lit("]")), F.col("label"))
    keys = part(F.concat(F.lit("value_code["), "raw", F.lit("]")), F.col("raw"), "special_values")
    texts = variables.select("survey", "code", shown).unionByName(values.select("survey", "code", F.explode(F.array(labels, keys)).alias("x")))
    found = find_artifacts(texts.select("survey", "code", "x.*"), only=F.col("only")).drop("text", "only")
    return found.withColumn("severity", severity(F.col("pattern_name"))).withColumn("suggestion", suggestion(F.col("pattern_name")))


def audit_statistics(variables: DataFrame, values: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(survey, measure, value, n): totals, variables by section, findings by pattern, severity and type."""
    v = variables.select("survey", measures(("variables", "all", 1), ("section", F.col("section"), 1)))
    w = values.select("survey", measures(("value_codes", "all", 1)))
    a = artifacts.select("survey", measures(("pattern", F.col("pattern_name"), 1), ("severity", F.col("severity"), 1), ("type", F.col("type"), 1)))
    rows = v.unionByName(w).unionByName(a).select("survey", "x.*").groupBy("survey", "measure", "value").agg(F.sum("n").alias("n"))
    sections = variables.groupBy("survey").agg(F.count_distinct("section").alias("n")).select("survey", F.lit("sections").alias("measure"), F.lit("all").alias("value"), "n")
    return rows.unionByName(sections)


def recommendations(artifacts: DataFrame) -> DataFrame:
    """(survey, kind, advice), each once: what to do about the findings, in five kinds."""
    where, text = F.col("code"), F.col("matched")
    say = lambda lead, tail="": F.concat(where, F.lit(f": {lead} '"), text, F.lit(f"'{tail}"))
    kinds = [
        (["placeholders"], "placeholder_filling", F.concat(say("Replace", " - "), F.col("suggestion"))), (["interviewer_instructions"], "instruction_removal", say("Remove")),
        (["binary_marking", "scale_abbreviations"], "value_label_cleaning", say("Convert", " to natural language")), (["skip_logic"], "question_reformulation", say("Remove routing logic")),
        (["response_codes", "special_values"], "code_handling", say("Handle special code")),
    ]
    kind = advice = None
    for types, name, line in kinds:
        hit = F.col("type").isin(types)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        advice = F.when(hit, line) if advice is None else advice.when(hit, line)
    return artifacts.select("survey", kind.alias("kind"), advice.alias("advice")).where("kind is not null").distinct()


def label_review(values: DataFrame) -> DataFrame:
    """(survey, code, n_options, has_missing, is_scale, issue) for each variable: a scale of more than ten labels, or more than two labels that are numbers."""
    low = F.lower("label")
    any_of = lambda parts: F.bool_or(F.coalesce(low.rlike("|".join(parts)), F.lit(False)))
    per = values.groupBy("survey", "code").agg(
        F.count(F.lit(1)).alias("n_options"), F.count_distinct("label").alias("__d"), any_of(REVIEW_MISSING).alias("has_missing"), any_of(REVIEW_SCALE).alias("is_scale"),
        F.count_if(F.trim("label").rlike(r"^\d+$")).alias("__numbers"),
    )
    issue = F.when((F.col("__d") > 10) & F.col("is_scale"), "long_scale").when(F.col("__numbers") > 2, "numeric_labels")
    return per.withColumn("issue", issue).drop("__d", "__numbers")


def open_text(variables: DataFrame) -> DataFrame:
    """(survey, section, code, kind): variables whose ``values`` (raw JSON text) is given but is no object, such as "String variable": answered in words. ``kind`` is what stands there."""
    given = F.col("values").isNotNull() & F.from_json("values", "map<string,string>").isNull()
    return variables.where(given).select("survey", "section", "code", F.col("values").alias("kind"))


def label_summary(review: DataFrame) -> DataFrame:
    """(survey, n_variables, n_with_missing, n_scales, min_options, max_options, median_options, n_issues)."""
    return review.groupBy("survey").agg(
        F.count(F.lit(1)).alias("n_variables"), F.count_if("has_missing").alias("n_with_missing"), F.count_if("is_scale").alias("n_scales"), F.min("n_options").alias("min_options"),
        F.max("n_options").alias("max_options"), F.median("n_options").alias("median_options"), F.count("issue").alias("n_issues"),
    )


def alignment(data_codes: DataFrame, variables: DataFrame) -> DataFrame:
    """(n_both, n_data_only, n_codebook_only, overlap): codes (``code``) of data and codebook; overlap in percent of the codebook's."""
    a = data_codes.select("code").distinct().withColumn("__a", F.lit(1))
    b = variables.select("code").distinct().withColumn("__b", F.lit(1))
    both = a.join(b, "code", "full_outer")
    n = both.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), F.count_if(F.col("__b").isNull()).alias("n_data_only"), F.count_if(F.col("__a").isNull()).alias("n_codebook_only"))
    return n.withColumn("overlap", F.round(F.try_divide(100.0 * F.col("n_both"), F.col("n_both") + F.col("n_codebook_only")), 4))


def compare_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(code, state, sections_a, sections_b, base_known): each code as common, only_a or only_b, its sections, and whether its base name stands in both."""
    side = lambda rows, s: rows.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("section")), "|").alias(f"sections_{s}"))
    both = side(a, "a").join(side(b, "b"), "code", "full_outer").withColumn("base", base_name(F.col("code")))
    bases = lambda rows, s: rows.select(base_name(F.col("code")).alias("base")).distinct().withColumn(f"__{s}", F.lit(True))
    known = both.join(bases(a, "a"), "base", "left").join(bases(b, "b"), "base", "left")
    state = F.when(F.col("sections_b").isNull(), "only_a").when(F.col("sections_a").isNull(), "only_b").otherwise("common")
    return known.select("code", state.alias("state"), "sections_a", "sections_b", (F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("base_known"))


def scale_key(pairs: Column) -> Column:
    """A scale (array of raw and label) as text, the same for any order of its pairs; its md5 identifies it."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(x["raw"], F.lit("="), x["label"])), ";")


def scales(variables: DataFrame, values: DataFrame, adjusted: Column) -> DataFrame:
    """(survey, code, pos, scale, adjusted): for each variable with labels its scale and the adjusted one, as text. ``adjusted``: a label's new text."""
    rows = values.withColumn("__adjusted", adjusted)
    pair = lambda c: F.collect_list(F.struct(F.col("raw"), F.col(c).alias("label")))
    per = rows.groupBy("survey", "code").agg(scale_key(pair("label")).alias("scale"), scale_key(pair("__adjusted")).alias("adjusted"))
    return variables.groupBy("survey", "code").agg(F.min("var_pos").alias("pos")).join(per, ["survey", "code"])


def scale_mapping(records: DataFrame) -> DataFrame:
    """(scale, mapped): of the adjusted scales that records have for one scale, the first by ``pos``. Counted by scale before they meet."""
    return records.groupBy("scale").agg(F.min_by("adjusted", "pos").alias("mapped"))


def scale_conflicts(records: DataFrame) -> DataFrame:
    """Records whose adjusted scale isn't the one that their scale is mapped to."""
    return records.join(scale_mapping(records), "scale").where("adjusted <> mapped")


def apply_mapping(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """``adjusted`` as mapped, and ``was_mapped``; scales that the mapping lacks stay as they are."""
    return records.join(mapping, "scale", "left").withColumn("was_mapped", F.col("mapped").isNotNull()).withColumn("adjusted", F.coalesce("mapped", "adjusted")).drop("mapped")


def collapse_scale(raw: Column, label: Column, low: str, high: str) -> Column:
    """Of a scale from 0 to 10 the five labels; other values keep their label."""
    k = raw.try_cast("int")
    return (
        F.when(k.between(0, 1), f"Strongly {low}").when(k.between(2, 3), f"Somewhat {low}").when(k.between(4, 6), f"Neither {low} nor {high}")
        .when(k.between(7, 8), f"Somewhat {high}").when(k.between(9, 10), f"Strongly {high}").otherwise(label)
    )


def closed_category(category: Column) -> Column:
    """In lower case and trimmed, if it is one of the categories; else 'other'."""
    own = F.lower(F.trim(category))
    return F.when(own.isin(CATEGORIES), own).otherwise("other")


def clean_enriched(question: Column, original: Column) -> Column:
    """A blank result as the original question."""
    return F.coalesce(F.nullif(F.trim(question), F.lit("")), original)


def clean_notes(notes: Column) -> Column:
    """'none' and 'no change(s)' as nothing."""
    own = F.coalesce(F.trim(notes), F.lit(""))
    return F.when(F.lower(own).rlike(r"^(none|no changes?)\.?$"), "").otherwise(own)


def enrich(
    rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], added: str, key: str, attempts: int = 2, skip: int = 0, log: str | None = None, batch_rows: int | None = None, parts: int = 1,
) -> DataFrame:
    """``rows`` with the columns ``added`` (DDL) that ``fn`` gives, ``failed``, ``retried``, ``attempt`` and ``error``; rows that failed, and only they, are tried again, ``attempts`` times in all.

    ``fn`` takes and returns a pandas frame of at most ``batch_rows`` rows (None: a whole batch of Spark's) with a boolean ``failed``. If it raises on
    several rows, each is tried alone, so a row fails for its own sake. ``skip``: the first rows by ``key`` that are left out.

    Calls are dear and needn't give the same twice: every result is written to the table ``log`` (by default a new one in the shared folder) before anything is
    made of it, and looked up there by key. A key is called once an attempt, and a run that is given the ``log`` of one that broke off goes on from there. A part
    (of ``parts``, by hash of the key) is in the log when all of it is done; only what was under way then, or in a task that was lost, is called again.
    Runs its calls at once. ``key`` is unique; a null one counts as a key.

    What failed is kept as a table in the shared folder, which the next attempt reads instead of all rows (their types must be ones that Parquet has; void
    columns are made again); two such tables are there at most. The log, which grows with rows and attempts, is joined by merging and never broadcast.
    """
    spark, new = rows.sparkSession, StructType.fromDDL(added)
    names = [f.name for f in new]
    log = log or shared_path(spark, "attempts")
    written = StructType([StructField("key", StringType()), StructField("attempt", IntegerType()), *new.fields, StructField("failed", BooleanType()), StructField("error", StringType())])
    empty = spark.createDataFrame([], written)
    empty.write.mode("append").parquet(log)
    begun = not spark.read.schema(written).parquet(log).isEmpty()
    if skip:
        first = rows.select(key).orderBy(key).limit(skip)
        rows = rows.join(first, rows[key].eqNullSafe(first[key]), "left_anti")

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(batch.copy()).assign(error=None)
        except Exception as e:
            if len(batch) == 1:
                return batch.assign(**dict.fromkeys(names), failed=True, error=f"{type(e).__name__}: {e}")
            return pd.concat([call(batch.iloc[[k]]) for k in range(len(batch))])

    def run(attempt: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = batch.pop("__key").to_numpy()
                size = batch_rows or max(1, len(batch))
                for at in range(0, len(batch), size):
                    out = call(batch.iloc[at : at + size].reset_index(drop=True)).assign(key=keys[at : at + size], attempt=attempt)
                    yield out[written.names]

        return of

    def tried(since: int) -> DataFrame:
        done = spark.read.schema(written).parquet(log).where(F.col("attempt") >= since)
        return done.groupBy(F.col("key").alias("__k")).agg(F.max("attempt").alias("__tried"), F.max_by("failed", "attempt").alias("__failed")).hint("merge")

    keyed = rows.withColumn("__key", F.col(key).cast("string"))
    same = F.col("__key").eqNullSafe(F.col("__k"))
    kept = [c for c, kind in keyed.dtypes if kind != "void"]
    folders = [shared_path(spark, "open") for _ in range(2)]
    left, n_left = keyed.withColumn("__tried", F.lit(0)), 0
    if begun:
        left = keyed.join(tried(1), same, "left").where(F.coalesce("__failed", F.lit(True))).select(*kept, F.coalesce("__tried", F.lit(0)).alias("__tried"))
        left = stored(left, "open", folders[0])
        n_left = left.count()
    for attempt in range(1, attempts + 1):
        for part in range(parts):
            due = left.where((F.col("__tried") == attempt - 1) & (F.pmod(F.xxhash64(F.coalesce("__key", F.lit(""))), F.lit(parts)) == part))
            due = spread(due, "__key") if n_left >= spark.sparkContext.defaultParallelism else due  # few rows stay in one task
            due = due.select(*[F.col(c) if c in due.columns else F.lit(None).alias(c) for c in keyed.columns])
            due.mapInPandas(run(attempt), written).write.mode("append").parquet(log)
        if attempt < attempts:
            left = stored(left.drop("__tried").join(tried(attempt).where("__failed"), same).select(*kept, "__tried"), "open", folders[attempt % 2])
            n_left = left.count()
            if not n_left:
                break
    last = spark.read.schema(written).parquet(log).groupBy(F.col("key").alias("__k")).agg(F.max_by(F.struct(*written.names[1:]), "attempt").alias("__last"))
    done = keyed.join(last.hint("merge"), same)
    return done.select(*rows.columns, *[F.col(f"__last.{n}").alias(n) for n in names], "__last.failed", (F.col("__last.attempt") > 1).alias("retried"), "__last.attempt", "__last.error")


def pack_chunks(pages: DataFrame, doc: str, order: str, text: str, most: int = 50_000) -> DataFrame:
    """(doc, chunk, n_pages, n_chars, first, last): consecutive pages joined while they stay within ``most`` characters; a longer page is a chunk of its own.

    A fold over a document's pages in order, which are one array: documents are manuals and conversations, not corpora.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))))
    start = F.struct(F.array().cast("array<struct<first:bigint,last:bigint,n_pages:int,n_chars:int>>").alias("done"), F.lit(None).cast("struct<first:bigint,last:bigint,n_pages:int,n_chars:int>").alias("now"))
    fresh = lambda p: F.struct(p["at"].cast("long").alias("first"), p["at"].cast("long").alias("last"), F.lit(1).alias("n_pages"), p["n"].alias("n_chars"))
    grown = lambda s, p: F.struct(s["now"]["first"].alias("first"), p["at"].cast("long").alias("last"), (s["now"]["n_pages"] + 1).alias("n_pages"), (s["now"]["n_chars"] + p["n"]).alias("n_chars"))

    def add(s: Column, p: Column) -> Column:
        none = s["now"].isNull()
        full = ~none & (s["now"]["n_chars"] + p["n"] > most) & (s["now"]["n_chars"] > 0)
        done = F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(none | full, fresh(p)).otherwise(grown(s, p)).alias("now"))

    folded = pages.groupBy(F.col(doc).alias("doc")).agg(ordered.alias("p")).select("doc", F.aggregate("p", start, add, lambda s: F.concat(s["done"], F.array(s["now"]))).alias("chunks"))
    return folded.select("doc", F.posexplode("chunks").alias("chunk", "c")).select("doc", "chunk", "c.*")


def merge_chunks(rows: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Codebook rows of several chunks: of a code within a section the one of the latest chunk."""
    rank = F.row_number().over(Window.partitionBy("survey", "section", "code").orderBy(F.desc(chunk)))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")
