"""Surveys from files and tables, loaded whole: identity, country, codebook; and datasets written back."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.builder import Survey, build_dataset
from ..operators.evaluation import composite_id
from ..operators.respondents import Draw
from ..operators.testsets import feature_orderings, generate_options_context, sample_by_size
from ..operators.variations import generate as generate_surface_forms
from .files import load_codebook, read_survey_files, write_jsonl
from .splits import spread

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SurveyConfig:
    """Where a survey is and which columns name a respondent (several are joined) and the country. ``format``: csv, parquet or table."""

    name: str
    data: tuple[str, ...]
    codebook: str
    id_columns: tuple[str, ...]
    country_column: str | None = None
    format: str = "csv"
    encoding: str = "UTF-8"
    concepts: dict[str, list[str]] = field(default_factory=dict)


def read_survey(spark: SparkSession, config: SurveyConfig) -> DataFrame:
    if config.format == "csv":
        return read_survey_files(spark, list(config.data), config.encoding)
    if config.format == "parquet":
        return spark.read.option("mergeSchema", "true").parquet(*config.data)
    return spark.table(config.data[0])


def load_survey(spark: SparkSession, config: SurveyConfig) -> Survey:
    """The wide rows with respondent_id and country, answers as strings, and the codebook. Caching is the caller's: ``persist`` the rows.

    A missing id or country column is an error; codes that the data lacks are passed over with a warning. Rows are read lazily.
    """
    rows = read_survey(spark, config)
    rows = rows if config.format == "table" else spread(rows)
    lost = [c for c in (*config.id_columns, *([config.country_column] if config.country_column else [])) if c not in rows.columns]
    if lost:
        raise ValueError(f"{config.name}: no column {', '.join(lost)}")
    variables, values = load_codebook(spark, config.codebook)
    known = [r["code"] for r in variables.select("code").distinct().collect()]  # a codebook's codes
    codes = [c for c in rows.columns if c in set(known)]
    if gone := sorted(set(known) - set(codes)):
        log.warning("%s: %d codes of the codebook have no column, such as %s", config.name, len(gone), ", ".join(gone[:5]))
    country = F.col(f"`{config.country_column}`").cast("string") if config.country_column else F.lit(None).cast("string")
    wide = rows.select(composite_id(rows, list(config.id_columns)).alias("respondent_id"), country.alias("country"), *[F.col(f"`{c}`").cast("string").alias(c) for c in codes])
    return Survey(config.name, wide, variables, values, codes, config.concepts)


def load_all(spark: SparkSession, configs: list[SurveyConfig], skip_errors: bool = True) -> dict[str, Survey]:
    """The surveys that could be loaded, by name; others are named in a warning, or raise without ``skip_errors``."""
    found = {}
    for c in configs:
        try:
            found[c.name] = load_survey(spark, c)
        except Exception:
            if not skip_errors:
                raise
            log.warning("survey %s is left out", c.name, exc_info=True)
    return found


def long_responses(surveys: dict[str, Survey]) -> DataFrame:
    """(survey, respondent_id, country, code, raw) of several surveys, whose wide schemas differ; none is an error."""
    from ..operators.decode import to_long

    found = None
    for name, s in surveys.items():
        rows = to_long(s.wide, s.codes).select(F.lit(name).alias("survey"), "respondent_id", "country", "code", "raw")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no surveys")
    return found


def write_base_instances(surveys: dict[str, Survey], draw: Draw, n_targets: int, n_respondents: int, path: str) -> None:
    """Instances of all surveys as JSON lines, a folder for each survey."""
    found, _ = build_dataset(list(surveys.values()), draw, n_targets, n_respondents, skip_errors=False)
    if found is None:
        raise ValueError("no surveys")
    write_jsonl(found, path, by_survey=True)


def write_test_sets(instances: DataFrame, path: str, n: int | None = 500, seed: int = 42, skip: tuple[str, ...] = (), prefix: str = "") -> list[str]:
    """The three kinds of test sets as JSON lines in folders below ``path``; returns the folders written. ``skip``: surface_form, options_context or feature_order."""
    items = F.transform("questions", lambda x: F.concat(x["question"], F.lit("="), x["answer"]))

    def orderings() -> DataFrame:
        found = feature_orderings(instances, items, seed)
        if n is None:
            return found
        sizes = found.select("example_id", "n_features").distinct()
        return found.join(sample_by_size(sizes, "n_features", n, seed).select("example_id"), "example_id", "left_semi")

    kinds = {
        "surface_form": lambda: generate_surface_forms(instances, n, seed=seed), "options_context": lambda: generate_options_context(instances, n, seed=seed), "feature_order": orderings,
    }
    written = []
    for kind, make in kinds.items():
        if kind not in skip:
            written.append(f"{path.rstrip('/')}/{prefix}{kind}")
            write_jsonl(make(), written[-1])
    return written


def read_test_set(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """A test set as written; with ``like``, typed as that frame is, so that it reads back equal."""
    return spark.read.schema(like.schema).json(path) if like is not None else spark.read.json(path)
