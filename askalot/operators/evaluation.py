"""Predictions held against instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame, instances: DataFrame | None = None, by: str = "target_code") -> DataFrame:
    """(by, n, accuracy) of predictions (example_id, prediction) that belong to an instance. Predictions that bring ``by`` and ``answer`` of their instance need no join."""
    joined = predictions if instances is None else predictions.select("example_id", "prediction").join(instances.select("example_id", by, "answer"), "example_id")
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("answer")).cast("double")), 6).alias("accuracy"))


def compare_levels(rows: DataFrame, levels: list[str]) -> DataFrame:
    """(base_id, one column a level): 1 where the prediction is the answer, 0 where not, null without an instance at that level."""
    right = (F.col("prediction") == F.col("answer")).cast("int")
    return rows.withColumn("__right", right).groupBy("base_id").pivot("profile_type", levels).agg(F.max("__right"))


def consistency(predictions: DataFrame) -> DataFrame:
    """(example_id, all_agree, n_unique, majority, majority_count) over (example_id, pos, prediction); of equal counts the first by pos."""
    counts = predictions.groupBy("example_id", "prediction").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    best = F.max_by(F.struct("prediction", "n"), F.struct(F.col("n"), -F.col("pos")))
    out = counts.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_unique"), best.alias("b"))
    return out.select("example_id", (F.col("n_unique") == 1).alias("all_agree"), "n_unique", F.col("b.prediction").alias("majority"), F.col("b.n").alias("majority_count"))


def nested(small: DataFrame, large: DataFrame) -> DataFrame:
    """(respondent_id, nested): are all codes of the small profile in the large one?"""
    found = small.select("respondent_id", "code").join(large.select("respondent_id", "code", F.lit(True).alias("__in")).distinct(), ["respondent_id", "code"], "left")
    return found.groupBy("respondent_id").agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("nested"))


def dedup_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``unique_id``: the id, with _1, _2, ... in the order given where it occurs more than once."""
    own = Window.partitionBy(key)
    n, k = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy(order))
    return rows.withColumn("unique_id", F.when(n > 1, F.concat_ws("_", F.col(key).cast("string"), k.cast("string"))).otherwise(F.col(key).cast("string")))


def composite_id(rows: DataFrame, parts: list[str], separator: str = "_"):
    """The parts joined: null as NA, whole numbers without a fraction, other values trimmed."""
    kinds = dict(rows.dtypes)

    def text(name: str):
        c = F.col(name)
        if kinds[name] in ("double", "float"):
            whole = (c == F.floor(c)) & (F.abs(c) < 2**53)
            shown = F.when(whole, c.try_cast("long").cast("string")).otherwise(c.cast("string"))
        else:
            shown = F.trim(c.cast("string"))
        return F.coalesce(shown, F.lit("NA"))

    return F.concat_ws(separator, *map(text, parts))


def id_checks(rows: DataFrame, key: str, country: str) -> DataFrame:
    """(n, n_ids, n_duplicates, n_no_country)."""
    ids = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(country).isNull()).alias("n_no_country"))
    totals = ids.agg(F.sum("n").alias("n"), F.count(key).alias("n_ids"), F.sum("n_no_country").alias("n_no_country"))
    return totals.select("n", "n_ids", (F.col("n") - F.col("n_ids")).alias("n_duplicates"), "n_no_country")
