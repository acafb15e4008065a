"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and becomes the checkpoint folder, on one machine
    only: executors of a cluster wouldn't share it, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="askalot-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Has Spark remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as the query that wrote them has ended. For queries whose result is written out."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage cut as by ``cut``, but compressed, by column, and of known size."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    with shuffle_files_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int) -> str:
    """The name of a table of ``df``, which is partitioned by ``key`` into ``buckets``: joins on that key don't shuffle it again. ``drop_stored`` ends it."""
    spark = df.sparkSession
    name = f"askalot_{uuid.uuid4().hex}"
    with shuffle_files_freed(spark):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, "table")).saveAsTable(name)
    return name


def drop_stored(spark: SparkSession, name: str) -> None:
    discard(spark.table(name))
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``stored`` or ``stored_by`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
