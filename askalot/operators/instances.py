"""Prediction instances: a respondent's profile with a held-out target question, and prompts from them."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decode import is_missing, valid_options
from .profiles import ProfileConfig, feature_pool, profiles


def build_instances(decoded: DataFrame, variables: DataFrame, values: DataFrame, targets: list[str], config: ProfileConfig, survey: str) -> DataFrame:
    """One row per respondent and target that has a valid answer. Targets are no features; an answer that isn't an option is appended.

    Equal question texts collapse: first position, last label.
    """
    pool = feature_pool(variables, excluded=targets)
    chosen = profiles(decoded, pool, decoded.select("respondent_id").distinct(), config).join(variables.select("code", "var_pos", "question"), "code")
    asked = chosen.groupBy("respondent_id", "question").agg(F.min(F.struct("section_pos", "pick")).alias("pos"), F.max_by("label", F.struct("section_pos", "pick")).alias("answer"))
    rows = asked.groupBy("respondent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "question", "answer"))).alias("questions"))
    held = decoded.where(F.col("code").isin(targets) & ~is_missing(F.col("label")))
    target = variables.select("code", F.col("question").alias("target_question"), F.col("section").alias("target_section")).join(valid_options(values), "code")
    out = held.join(F.broadcast(target), "code").join(rows, "respondent_id")
    base = F.translate(F.concat_ws("_", F.lit(survey), "respondent_id", "code"), " /", "__")
    options = F.when(F.array_contains("options", F.col("label")), F.col("options")).otherwise(F.concat("options", F.array("label")))
    return out.select(
        F.concat_ws("_", base, F.lit(config.profile_type)).alias("example_id"), base.alias("base_id"), F.lit(survey).alias("survey"),
        F.col("respondent_id").alias("id"), "country", F.transform("questions", lambda x: F.struct(x["question"], x["answer"])).alias("questions"),
        "target_question", F.col("code").alias("target_code"), "target_section", F.col("label").alias("answer"), F.col("raw").alias("answer_raw"),
        options.alias("options"), F.lit(config.profile_type).alias("profile_type"),
    )


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: quoted by Spark, then characters beyond ASCII as \\uXXXX, in pairs beyond the first plane."""
    raw = F.to_json(F.struct(text.alias("x")))
    quoted = F.substr(raw, F.lit(6), F.length(raw) - 6)
    escape = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    ascii_only = F.array_join(F.transform(F.split(quoted, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), escape(c)).otherwise(c)), "")
    return F.when(quoted.rlike(r"[^\x00-\x7f]"), ascii_only).otherwise(quoted)


LINE = {
    "qa": lambda q, a: F.concat(F.lit("Q: "), q, F.lit("\nA: "), a),
    "interview": lambda q, a: F.concat(F.lit("Interviewer: "), q, F.lit("\nRespondent: "), a),
    "bullet": lambda q, a: F.concat(F.lit("- "), q, F.lit(": "), a),
    "colon": lambda q, a: F.concat(q, F.lit(": "), a),
    "arrow": lambda q, a: F.concat(q, F.lit(" \u2192 "), a),
    "brackets": lambda q, a: F.concat(F.lit("["), q, F.lit("] "), a),
    "xml": lambda q, a: F.concat(F.lit("<question>"), q, F.lit("</question>\n<answer>"), a, F.lit("</answer>")),
    "json": lambda q, a: F.concat(F.lit('{"q": '), json_string(q), F.lit(', "a": '), json_string(a), F.lit("}")),
    "narrative": lambda q, a: F.concat(F.lit('When asked "'), q, F.lit('", they answered "'), a, F.lit('".')),
    "card": lambda q, a: F.concat(q, F.lit(" | "), a),
}


def formatted(questions: Column, line: str | Callable[[Column, Column], Column] = "colon", separator: str = "\n") -> Column:
    """The profile as text: a preset's name or any function of question and answer columns for each line."""
    one = LINE[line] if isinstance(line, str) else line
    return F.array_join(F.transform(questions, lambda x: one(x["question"], x["answer"])), separator)


def numbered(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")


def target_text(question: Column, options: Column, include_options: bool = True, style: str = "list") -> Column:
    """The target question, with its options as a numbered ``list``, ``inline`` or as ``bullets``; without options the question alone."""
    if not include_options:
        return question
    listed = {
        "list": lambda: F.concat(F.lit("\n\nOptions:\n"), numbered(options)),
        "inline": lambda: F.concat(F.lit("\n\nOptions: "), F.array_join(options, ", ")),
        "bullets": lambda: F.concat(F.lit("\n\nOptions:\n"), F.array_join(F.transform(options, lambda o: F.concat(F.lit("\u2022 "), o)), "\n")),
    }
    if style not in listed:
        raise ValueError(f"unknown options style: {style}")
    return F.when(F.size(options) > 0, F.concat(question, listed[style]())).otherwise(question)


DEFAULT_TEMPLATE = "Here is information about a survey respondent:\n\n{profile}\n\nBased on this information, please answer:\n{target_with_options}"


def fill(template: str, parts: dict[str, Column]) -> Column:
    """A template's text with {name} places filled; what a part holds is never read as a place. Doubled braces stand for one."""
    pieces = [(text, name) for text, name, _, _ in Formatter().parse(template)]
    return F.concat(*[c for text, name in pieces for c in ([F.lit(text)] if text else []) + ([parts[name]] if name is not None else [])])


def to_prompt(instances: DataFrame, line: str | Callable[[Column, Column], Column] = "colon", separator: str = "\n", include_options: bool = True, style: str = "list", template: str | None = None) -> DataFrame:
    """Adds ``prompt``: by the default template, or one with {profile}, {target}, {options} and {target_with_options}."""
    question, options = F.col("target_question"), F.col("options")
    parts = {
        "profile": formatted(F.col("questions"), line, separator), "target": question, "options": numbered(options),
        "target_with_options": target_text(question, options, include_options, style),
    }
    return instances.withColumn("prompt", fill(template or DEFAULT_TEMPLATE, parts))


def qa_text(questions: Column) -> Column:
    """The profile as questions and answers, an empty line between them."""
    return formatted(questions, "qa", "\n\n")
