"""Long form, labels and missing answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and parts of labels that mean "no answer".
MISSING_LABELS = ["Missing", "No answer", "Refused", "Don't know", "Not applicable"]
MISSING_PATTERNS = ["missing", "refused", "don't know", "no answer", "not asked", "not applicable", "nan", "na"]


def to_long(wide: DataFrame, codes: list[str], keys: tuple[str, ...] = ("respondent_id", "country")) -> DataFrame:
    """A row for each answer that isn't null. ``explode`` keeps a partitioning by respondent, ``unpivot`` wouldn't."""
    answers = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("raw")) for c in codes])).alias("x")
    return wide.select(*keys, answers).select(*keys, "x.code", "x.raw").where("raw is not null")


def integer_key(raw: Column) -> Column:
    """'1.0' and '1.7' as '1'; null if it is no finite number. What doesn't begin as one isn't cast: a failing cast costs an exception inside Spark, many times all else."""
    return F.when(raw.rlike(r"^[\x00-\x20]*[-+.0-9]"), raw.try_cast("double").try_cast("long").cast("string"))


def written_integer(raw: Column) -> Column:
    """'1' and ' +1' as '1'; null if it isn't written as an integer. What doesn't begin as one or has a fraction isn't cast, for the same reason."""
    return F.when(raw.rlike(r"^[\x00-\x20]*[-+0-9][^.]*$"), raw.try_cast("long").cast("string"))


def decode_answers(answers: DataFrame, values: DataFrame, strict_int: bool = False) -> DataFrame:
    """Adds ``label``: by the raw value, else by its integer part (with ``strict_int``: only if it is an integer as written), else the raw value itself.

    Codebooks are small next to answers; Spark broadcasts them when their size allows.
    """
    exact = values.select("code", "raw", F.col("label").alias("__exact"))
    whole = values.select("code", F.col("raw").alias("__key"), F.col("label").alias("__whole"))
    key = written_integer(F.col("raw")) if strict_int else integer_key(F.col("raw"))
    joined = answers.join(exact, ["code", "raw"], "left").withColumn("__key", key).join(whole, ["code", "__key"], "left")
    return joined.select(*answers.columns, F.coalesce("__exact", "__whole", "raw").alias("label"))


def is_missing(label: Column, labels: list[str] | None = None, patterns: list[str] | None = None) -> Column:
    """Null, one of ``labels``, or holding one of ``patterns`` in any case."""
    labels = MISSING_LABELS if labels is None else labels
    patterns = MISSING_PATTERNS if patterns is None else patterns
    found = label.isNull() | label.isin(labels)
    for p in patterns:
        found = found | F.lower(label).contains(p)
    return found


def valid_options(values: DataFrame) -> DataFrame:
    """(code, options): labels that aren't missing, in codebook order; repeated labels stay."""
    kept = values.where(~is_missing(F.col("label")))
    sorted_labels = F.transform(F.array_sort(F.collect_list(F.struct("label_pos", "label"))), lambda x: x["label"])
    return kept.groupBy("code").agg(sorted_labels.alias("options"))


def missing_sql(label: str) -> str:
    """The same predicate as SQL."""
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in MISSING_LABELS)
    parts = " OR ".join("contains(lower({0}), '{1}')".format(label, p.replace("'", "''")) for p in MISSING_PATTERNS)
    return f"({label} IS NULL OR {label} IN ({listed}) OR {parts})"
