"""How a scan of files is dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Scans of this many splits (of some 128 MB at most, where files can be split) or more stay as they are on any cluster.
FEW = 64


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """A scan of files as it is, or dealt anew to as many tasks as the session has cores where its files give fewer splits than that, and than ``FEW``.

    Row-local plans have no exchange, so all their work would run in the few tasks of such a scan. So what is dealt is a few GB at most, however many cores
    there are, or files that can't be split; by ``keys`` where a join on them follows.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= min(cores, FEW):  # of a scan, this plans its splits and runs nothing
        return rows
    return rows.repartition(cores, *keys)


#: Tasks for each split of a scan, where what is read from it grows on its way.
TIMES = 8


def parts(rows: DataFrame) -> int:
    """How many tasks a shuffle of what is made of a scan of files needs: those of the session, or more as its files have more splits.

    A fixed number gives each task more rows the larger the input is, and windows and groups over them more memory.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), TIMES * rows.rdd.getNumPartitions())
