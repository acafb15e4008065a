"""Questions whose options differ from country to country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decode import is_missing


def option_spread(decoded: DataFrame, respondents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(code, n_global, avg_country, ratio): distinct answers of a country, on average over all countries, to distinct valid answers overall; for each value of ``by`` on its own.

    Two-step counting by (code, country), so a hot country isn't one task. One country or one answer gives no row.
    """
    countries = respondents.where("country is not null").select(*by, "country").distinct()
    per = decoded.groupBy(*by, "code", "country").agg(F.count_distinct("raw").alias("n"))
    n_countries = countries.groupBy(*by).agg(F.count(F.lit(1)).alias("n_countries"))
    total = decoded.where(~is_missing(F.col("label"))).groupBy(*by, "code").agg(F.count_distinct("raw").alias("n_global"))
    summed = per.groupBy(*by, "code").agg(F.sum("n").alias("n_sum"))
    both = total.join(summed, [*by, "code"])
    return (
        (both.join(n_countries, [*by]) if by else both.crossJoin(n_countries)).where("n_countries > 1 and n_global > 1")
        .select(*by, "code", "n_global", F.round(F.col("n_sum") / F.col("n_countries"), 6).alias("avg_country"), F.round(F.col("n_sum") / F.col("n_countries") / F.col("n_global"), 6).alias("ratio"))
    )


def country_specific(spread: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``country_specific``: whether a country shows fewer of the answers than ``threshold``, on average and strictly."""
    return spread.withColumn("country_specific", F.col("avg_country") / F.col("n_global") < threshold)


def override(targets: DataFrame, codes: list[str]) -> DataFrame:
    """(code, known): a given list in place of detection; codes that are no target are not known, for a warning."""
    own = targets.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(codes)], "code string")
    return own.join(targets.select("code", F.lit(True).alias("known")).distinct(), "code", "left").select("code", F.coalesce("known", F.lit(False)).alias("known"))


def option_counts(by_country: DataFrame, targets: DataFrame) -> DataFrame:
    """(code, n_global, avg_country): valid options of the codebook, and of a country on average."""
    per = by_country.groupBy("code").agg(F.round(F.avg(F.size("options")), 6).alias("avg_country"))
    return targets.select("code", F.size("options").alias("n_global")).join(per, "code")


def codes_of(values: DataFrame, variable: str) -> DataFrame:
    """(raw, label) of the variable that holds the country."""
    return values.where(F.col("code") == variable).select("raw", "label")


def country_options(decoded: DataFrame, values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(country, code, options): valid labels seen in the country, in codebook order; for each value of ``by``, which both tables have, on its own."""
    seen = decoded.where(~is_missing(F.col("label"))).select(*by, "country", "code", "label").distinct()
    ordered = values.groupBy(*by, "code", "label").agg(F.min("label_pos").alias("label_pos"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("label_pos", "label"))), lambda x: x["label"])
    return seen.join(ordered, [*by, "code", "label"]).groupBy(*by, "country", "code").agg(labels.alias("options"))


def country_of(code: Column, prefix: str) -> Column:
    """The country in a variable's name: after the prefix, without trailing digits, the last two letters in upper case."""
    return F.upper(F.right(F.regexp_replace(F.substr(code, F.lit(len(prefix) + 1)), r"\d+$", ""), F.lit(2)))


def concept_vars(variables: DataFrame, concept: str, prefixes: list[str], countries: DataFrame, min_countries: int = 3) -> DataFrame:
    """(concept, country, code, pos, var_pos): a concept's variables by country, in codebook order; none if fewer than ``min_countries`` have one."""
    found = None
    for p in prefixes:
        rows = variables.where(F.col("code").startswith(p)).select("code", "var_pos", country_of(F.col("code"), p).alias("country"))
        found = rows if found is None else found.unionByName(rows)
    found = found.dropDuplicates(["code"]).join(countries.select("country").distinct(), "country", "left_semi")
    enough = found.agg(F.count_distinct("country").alias("k")).where(F.col("k") >= min_countries)
    pos = F.row_number().over(Window.partitionBy("country").orderBy("var_pos")) - 1
    return found.crossJoin(enough).select(F.lit(concept).alias("concept"), "country", "code", pos.alias("pos"), "var_pos")


#: The section of a concept among targets.
CONCEPT = "__concept__"

# Prefixes of the variables of concepts that surveys share.
PRESETS = {
    "education_level": ["edlv"],
    "religion_denomination": ["rlgdn"],
    "religion_raised": ["rlgde"],
    "party_voted": ["prtvt", "prtvg", "prtvc"],
    "party_close": ["prtcl"],
}


def concepts(variables: DataFrame, prefixes: dict[str, list[str]], countries: DataFrame, min_countries: int = 3) -> DataFrame:
    """``concept_vars`` of several concepts."""
    found = None
    for name, own in prefixes.items():
        rows = concept_vars(variables, name, own, countries, min_countries)
        found = rows if found is None else found.unionByName(rows)
    return found


def representatives(found: DataFrame) -> DataFrame:
    """(code, section, first_code): each concept as one target, whose section marks it, with its first variable."""
    return found.groupBy("concept").agg(F.min_by("code", "var_pos").alias("first_code")).select(F.col("concept").alias("code"), F.lit(CONCEPT).alias("section"), "first_code")


def resolve(decoded: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, respondent_id, country, code, label): answers to the first variable of a respondent's country."""
    return decoded.join(concepts.where("pos = 0").select("concept", "country", "code"), ["country", "code"]).select("concept", "respondent_id", "country", "code", "label")


def coverage(decoded: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, country, n_vars, n_answers): answers counted ahead of the join, so that no country is one task."""
    answers = decoded.groupBy("country", "code").agg(F.count(F.lit(1)).alias("n"))
    return concepts.join(answers, ["country", "code"], "left").groupBy("concept", "country").agg(F.count_distinct("code").alias("n_vars"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"))
