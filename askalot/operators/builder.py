"""Datasets from surveys: drawn targets and respondents, regular and concept instances."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import each_of
from ..functions.hashing import order_key
from ..sources.shared import stored
from . import country as cty
from . import respondents as rsp
from .decode import is_missing

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Survey:
    """A survey's wide rows (respondent_id, country, one column a code), its codebook, and prefixes by concept."""

    name: str
    wide: DataFrame
    variables: DataFrame
    values: DataFrame
    codes: list[str]
    concepts: dict[str, list[str]] = field(default_factory=dict)


def concept_answers(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """``rows`` with (concept, code, label, options, raw, question, section): the answer to the first variable of the respondent's country.

    Respondents without a country, without a variable for it or without an answer give no row.
    """
    first = concepts.where("pos = 0").select("concept", F.col("country").alias("__country"), F.col("code").alias("__code"))
    joined = rows.join(first, F.upper("country") == F.col("__country"))
    one = F.try_element_at(F.filter("answers", lambda a: a["code"] == F.col("__code")), F.lit(1))
    found = joined.withColumn("__a", one).where("__a is not null")
    return found.select(*rows.columns, "concept", *[F.col(f"__a.{c}").alias(c) for c in ("code", "label", "options", "raw", "question", "section")])


def concept_instances(rows: DataFrame, concepts: DataFrame, draw: rsp.Draw, survey: str, wanted: list[str] | None = None, pool_sections: list[str] | None = None) -> DataFrame:
    """Instances whose target is a concept, asked by the variable of the respondent's country; ``target_concept`` names it.

    Missing answers and variables without options give none. All variables of the concepts are barred as features.
    The schema is that of regular instances; ids take the concept in place of a code.
    """
    own = concepts if wanted is None else concepts.where(F.col("concept").isin(wanted))
    barred = [r["code"] for r in own.select("code").distinct().collect()]  # variables of a codebook
    found = concept_answers(rows, own).where(~is_missing(F.col("label")) & (F.size("options") > 0))
    drawn = rsp.with_profile(found, draw.exclude(barred), pool_sections=pool_sections)
    kind = draw.config.profile_type
    base = rsp.base_id(survey, F.col("respondent_id"), F.col("concept"))
    kept = ["respondent_id", "country", "concept", "label", "options", "raw", "question", "code", "section"]
    out = rsp.with_questions(drawn.select(*kept, rsp.asked(F.col("features")).alias("questions")))
    return out.select(
        F.concat_ws("_", base, F.lit(kind)).alias("example_id"), base.alias("base_id"), F.lit(survey).alias("survey"), F.col("respondent_id").alias("id"), "country", "questions",
        F.col("question").alias("target_question"), F.col("code").alias("target_code"), F.col("section").alias("target_section"), F.col("label").alias("answer"), F.col("raw").alias("answer_raw"),
        rsp.with_answer(F.col("options"), F.col("label")).alias("options"), F.lit(kind).alias("profile_type"), F.col("concept").alias("target_concept"),
    )


def build_survey_dataset(survey: Survey, draw: rsp.Draw, n_targets: int, n_respondents: int, detect_country: bool = True, country_codes: list[str] | None = None) -> DataFrame:
    """Instances of drawn targets and respondents, regular and concept ones; ``target_concept`` is null for regular ones.

    The variables of drawn concepts are no features. Options of country-specific questions are those of the respondent's country. These questions
    are detected, or given by ``country_codes``: of these, codes that weren't drawn are named in a warning, and without any country all are passed over with one.
    """
    given = None if country_codes is None else {survey.name: country_codes}
    return build_dataset([survey], draw, n_targets, n_respondents, False, detect_country, given)[0]


@dataclass(frozen=True)
class Drawn:
    """What was drawn for a survey: its targets, the concepts among them, the codes that are no features, the sections that have any left."""

    survey: str
    regular: list[str]
    wanted: list[str]
    barred: list[str]
    sections: list[str]


def draw_targets(variables: DataFrame, values: DataFrame, concepts: DataFrame | None, draw: rsp.Draw, n: int) -> list[Drawn]:
    """``n`` targets of each survey by hash, out of the variables with labels and its concepts. Reads codebooks alone, those of all surveys in one job; what reaches the driver grows with them."""
    own = variables.where("sampleable") if "sampleable" in variables.columns else variables
    first = own.groupBy("survey", "code").agg(F.min_by("section", F.struct("section_pos", "var_pos")).alias("section"))
    fit = first.join(values.select("survey", "code").distinct(), ["survey", "code"]).where("section <> 'EXCLUDED'").select("survey", "code", "section")
    members: dict[str, dict[str, list[str]]] = {}
    if concepts is not None:
        for r in concepts.select("survey", "concept", "code", "var_pos").distinct().orderBy("var_pos").collect():
            members.setdefault(r["survey"], {}).setdefault(r["concept"], []).append(r["code"])
        fit = fit.join(concepts.select("survey", "code").distinct(), ["survey", "code"], "left_anti")
        fit = fit.unionByName(concepts.select("survey", F.col("concept").alias("code"), F.lit(cty.CONCEPT).alias("section")).distinct())
    rank = F.row_number().over(Window.partitionBy("survey").orderBy(order_key(draw.config.seed, F.col("code")), "code"))
    chosen: dict[str, list] = {}
    for r in fit.withColumn("__r", rank).where(F.col("__r") <= n).orderBy("survey", "__r").collect():
        chosen.setdefault(r["survey"], []).append(r)
    sections: dict[str, list[tuple[str, str]]] = {}
    for r in variables.select("survey", "section", "code").distinct().collect():
        sections.setdefault(r["survey"], []).append((r["section"], r["code"]))
    found = []
    for name, rows in sections.items():
        regular = [r["code"] for r in chosen.get(name, []) if r["section"] != cty.CONCEPT]
        wanted = [r["code"] for r in chosen.get(name, []) if r["section"] == cty.CONCEPT]
        barred = [*regular, *(c for w in wanted for c in members.get(name, {}).get(w, []))]
        out = {*draw.exclude(barred).excluded, *draw.always, ""}
        found.append(Drawn(name, regular, wanted, list(dict.fromkeys(barred)), sorted({s for s, c in rows if c not in out})))
    return found


def build_dataset(
    surveys: list[Survey], draw: rsp.Draw, n_targets: int, n_respondents: int, skip_errors: bool = True, detect_country: bool = True, country_codes: dict[str, list[str]] | None = None,
) -> tuple[DataFrame | None, list[str]]:
    """``build_survey_dataset`` of many surveys as one plan keyed by survey, and the names of those that couldn't be planned (with ``skip_errors``, each with a warning).

    Every survey's table is brought into the same form, so that decoding, drawing and assembling stand in the plan once, and the jobs that draw targets
    are as many for one survey as for fifty. ``country_codes``: given country-specific questions by survey, others are detected. Rows of a survey are counted by ``summary``.
    """
    if len({s.name for s in surveys}) < len(surveys):
        raise ValueError("surveys are told apart by name")
    raws, books, concepts, codes, planned, failed = None, None, None, [], [], []
    union = lambda a, b: b if a is None else a.unionByName(b, allowMissingColumns=True)
    for s in surveys:
        try:
            own = rsp.raw_rows(s.wide, s.name, s.codes)
            variables, values = s.variables.withColumn("survey", F.lit(s.name)), s.values.withColumn("survey", F.lit(s.name))
            found = cty.concepts(s.variables, s.concepts, s.wide).withColumn("survey", F.lit(s.name)) if s.concepts else None
        except Exception:
            if not skip_errors:
                raise
            log.warning("survey %s is left out", s.name, exc_info=True)
            failed.append(s.name)
            continue
        raws, books = union(raws, own), (variables, values) if books is None else (union(books[0], variables), union(books[1], values))
        concepts = concepts if found is None else union(concepts, found)
        codes += [(s.name, c, k) for k, c in enumerate(s.codes, 1)]
        planned.append(s)
    if raws is None:
        return None, failed
    spark, (variables, values) = raws.sparkSession, books
    drawn = draw_targets(variables, values, concepts, draw, n_targets)
    places = spark.createDataFrame(codes, "survey string, code string, at int")
    plan = spark.createDataFrame([(d.survey, d.regular, d.wanted, d.barred, d.sections) for d in drawn], "survey string, targets array<string>, concepts array<string>, barred array<string>, sections array<string>")
    # The surveys are read twice, for the respondents drawn and for the distinct answers to targets. Both are small and stored: all that follows reads them and not the surveys.
    # Rank and not number, so that repeated rows of a respondent stay together; each task keeps the first n of a survey before any shuffle.
    order = F.dense_rank().over(Window.partitionBy("survey").orderBy(order_key(draw.config.seed, F.col("respondent_id")), "respondent_id"))
    people = stored(raws.where("respondent_id is not null").withColumn("__r", order).where(F.col("__r") <= n_respondents).drop("__r"), "respondents")
    codebooks, plan = F.broadcast(rsp.books(variables, values, places)), F.broadcast(plan)  # a row a survey, as large as its codebook
    chosen = rsp.keyed_answer_rows(people, codebooks).join(plan, "survey")
    options = _options(planned, variables, values, drawn, detect_country, country_codes)
    found = _instances(chosen, draw, options).withColumn("target_concept", F.lit(None).cast("string"))
    if any(d.wanted for d in drawn):
        found = found.unionByName(_concept_instances(chosen, concepts, draw))
    return found, failed


def _options(surveys: list[Survey], variables: DataFrame, values: DataFrame, drawn: list[Drawn], detect: bool, given: dict[str, list[str]] | None) -> DataFrame | None:
    """(survey, country, code, options) of the targets whose options differ from country to country: given, or detected for surveys that nothing is given for."""
    regular = {d.survey: d.regular for d in drawn}
    listed = {name: [c for c in dict.fromkeys(own) if c in regular.get(name, [])] for name, own in (given or {}).items()}
    for name, own in (given or {}).items():
        if unknown := [c for c in dict.fromkeys(own) if c not in listed[name]]:
            log.warning("survey %s: country-specific codes that are no targets: %s", name, ", ".join(unknown))
    having = [s for s in surveys if regular.get(s.name)]
    if not having:
        return None
    columns = {s.name: [c for c in s.codes if c in regular[s.name]] for s in having}  # no other column is read
    raws = reduce(DataFrame.unionByName, [rsp.raw_rows(s.wide, s.name, columns[s.name]) for s in having])
    spark = raws.sparkSession
    if asked := [name for name, own in listed.items() if own]:
        placed = {r["survey"] for r in raws.where(F.col("survey").isin(asked) & F.col("country").isNotNull()).select("survey").distinct().collect()}
        for name in asked:
            if name not in placed:
                log.warning("survey %s has no countries: country-specific codes are passed over", name)
                listed[name] = []
    auto = [d.survey for d in drawn if d.survey not in listed and d.regular] if detect else []
    if not auto and not any(listed.values()):
        return None
    # A row for each country, and each answer that it gives: countries and options are counted over these. A row without a code stands for the country alone.
    places = spark.createDataFrame([(name, c, k) for name, own in columns.items() for k, c in enumerate(own, 1)], "survey string, code string, at int")
    rows = rsp.keyed_answer_rows(raws, F.broadcast(rsp.books(variables, values, places)))
    parts = ("code", "raw", "label")
    marked = F.concat(F.transform("answers", lambda a: F.struct(*[a[c].alias(c) for c in parts])), F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in parts])))
    every = rows.select("survey", "country", F.explode(marked).alias("a")).select("survey", "country", "a.*").distinct()
    seen = stored(every, "answers")
    long, countries = seen.where("code is not null"), seen.where("code is null")
    options = cty.country_options(long, values, by=("survey",))
    flags = spark.createDataFrame([(name, c) for name, own in listed.items() for c in own], "survey string, code string")
    if auto:
        spread = cty.option_spread(long.where(F.col("survey").isin(auto)), countries, by=("survey",))
        flags = flags.unionByName(cty.country_specific(spread).where("country_specific").select("survey", "code"))
    return options.join(flags, ["survey", "code"], "left_semi")


def _columns(draw: rsp.Draw, code: Column, rest: dict[str, Column]) -> list[Column]:
    """The columns of an instance with ``questions``, keyed by ``survey``."""
    base, kind = rsp.base_id(F.col("survey"), F.col("respondent_id"), code), F.lit(draw.config.profile_type)
    return [
        F.concat_ws("_", base, kind).alias("example_id"), base.alias("base_id"), F.col("survey"), F.col("respondent_id").alias("id"), F.col("country"), F.col("questions"),
        *[c.alias(name) for name, c in rest.items()], kind.alias("profile_type"),
    ]


def _instances(rows: DataFrame, draw: rsp.Draw, country_options: DataFrame | None) -> DataFrame:
    """Regular instances of rows that bring their ``targets``, ``barred`` codes and ``sections``. One profile serves all targets of a respondent."""
    held = F.filter("answers", lambda a: F.array_contains("targets", a["code"]) & ~a["target_missing"] & (a["n_labels"] > 0))
    drawn = rsp.with_asked(rows, draw, "barred", "sections").select("survey", "respondent_id", "country", "answers", "targets", "questions")
    each = each_of(drawn, F.when(F.size("questions") > 0, held), "t", "survey", "respondent_id", "country", "questions")
    options = F.col("t.options")
    if country_options is not None:
        listed = country_options.select(F.col("survey").alias("__s"), F.col("country").alias("__c"), F.col("code").alias("__code"), F.col("options").alias("__options"))
        each = each.join(listed, (F.col("survey") == F.col("__s")) & (F.col("country") == F.col("__c")) & (F.col("t.code") == F.col("__code")), "left")
        options = F.coalesce("__options", "t.options")
    rest = {
        "target_question": F.col("t.question"), "target_code": F.col("t.code"), "target_section": F.col("t.section"), "answer": F.col("t.target_label"), "answer_raw": F.col("t.raw"),
        "options": rsp.with_answer(options, F.col("t.target_label")),
    }
    return each.select(*_columns(draw, F.col("t.code"), rest))


def _concept_instances(rows: DataFrame, concepts: DataFrame, draw: rsp.Draw) -> DataFrame:
    """Concept instances of rows that bring the ``concepts`` drawn, by the first variable of the respondent's country."""
    first = concepts.where("pos = 0").select(F.col("survey").alias("__s"), "concept", F.col("country").alias("__country"), F.col("code").alias("__code"))
    joined = rows.join(first, (F.col("survey") == F.col("__s")) & (F.upper("country") == F.col("__country"))).where(F.array_contains("concepts", F.col("concept")))
    answer = F.try_element_at(F.filter("answers", lambda a: a["code"] == F.col("__code")), F.lit(1))
    fit = each_of(joined, F.array(answer), "t", "survey", "respondent_id", "country", "concept", "answers", "barred", "sections", "book_sections").where(~is_missing(F.col("t.label")) & (F.size("t.options") > 0))
    drawn = rsp.with_asked(fit, draw, "barred", "sections").select("survey", "respondent_id", "country", "concept", "t", "questions")
    rest = {
        "target_question": F.col("t.question"), "target_code": F.col("t.code"), "target_section": F.col("t.section"), "answer": F.col("t.label"), "answer_raw": F.col("t.raw"),
        "options": rsp.with_answer(F.col("t.options"), F.col("t.label")),
    }
    return rsp.with_questions(drawn).select(*_columns(draw, F.col("concept"), rest), F.col("concept").alias("target_concept"))


def summary(instances: DataFrame, n_ids: int = 5) -> DataFrame:
    """(survey, profile_type, n, first_ids): counts, and up to ``n_ids`` smallest ids joined by '|'.

    Ids are ranked before they are gathered, so a group holds ``n_ids`` of them.
    """
    key = ["survey", "profile_type"]
    counts = instances.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("example_id"))
    first = instances.select(*key, "example_id").withColumn("__r", rank).where(F.col("__r") <= n_ids)
    ids = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("example_id")), "|").alias("first_ids"))
    return counts.join(ids, key)
