"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where the session names none, a temporary folder takes its place, on one machine only: on a cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="askalot-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Has Spark remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder, for what is small, dear and read several times; the shuffle files of its making are gone then.

    ``path``: where to, instead of a new folder; what it held goes.
    """
    spark, mode = rows.sparkSession, "overwrite" if path else "error"
    path = path or shared_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.mode(mode).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)
