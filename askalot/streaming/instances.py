"""The row-local operators on streams: instances as respondents arrive, and audits and tests of what arrives.

All of them are stateless, so streams append and need no watermark. Samples of a fixed size, the detection of
country-specific questions and statistics need a whole set and are for batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import codebook as cbk
from ..operators import respondents as rsp
from ..operators import testsets as tst
from ..operators import variations as var


def respondents(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """A stream of wide rows from a folder that files arrive in."""
    return spark.readStream.schema(schema).format(format).load(path)


def instances(wide: DataFrame, variables: DataFrame, values: DataFrame, codes: list[str], targets: list[str], draw: rsp.Draw, survey: str, country_options: DataFrame | None = None) -> DataFrame:
    """Instances of a stream (or batch) of wide rows: the codebook is static, options by country, if any, come from an earlier batch."""
    return rsp.instances(rsp.answer_rows(wide, rsp.book(variables, values, codes), codes), targets, draw, survey, country_options=country_options)


def option_tests(rows: DataFrame) -> DataFrame:
    """Eligible option tests of a stream of instances, none left out."""
    return tst.generate_options_context(rows)


def surface_tests(rows: DataFrame) -> DataFrame:
    """Eligible surface-form tests of a stream of instances, none left out."""
    return var.generate(rows, require_variations=False)


def order_tests(rows: DataFrame, seed: int = 42) -> DataFrame:
    return tst.feature_orderings(rows, F.transform("questions", lambda x: F.concat(x["question"], F.lit("="), x["answer"])), seed)


def audit(texts: DataFrame, text: str = "text") -> DataFrame:
    """Traces of the instrument in a stream of texts, with severity and suggestion."""
    found = cbk.find_artifacts(texts, text)
    return found.withColumn("severity", cbk.severity(F.col("pattern_name"))).withColumn("suggestion", cbk.suggestion(F.col("pattern_name")))


def write(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the rows as Parquet; with ``available_now`` the query ends when what is there has been read."""
    out = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start(path)
