"""A name for a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside functions over arrays.

    A column that is named in a step of its own may be merged into a lambda by the optimizer, and be computed for every element.
    It is the end of an aggregate over nothing: what a ``transform`` returns is copied to its last string, what an aggregate returns isn't.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda own, _: own, body)


def each_of(rows: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` and each element of ``array`` as ``name``; elements that are null go.

    ``explode`` has the optimizer filter rows by the array's size below it, which computes the array a second time; the outer form doesn't.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


#: Rows whose values a memo is made of. What it holds has no bearing on results.
MEMO = 2_000


def remembered(rows: DataFrame, key: str, made: Callable[[DataFrame], DataFrame], *added: str) -> DataFrame:
    """``made`` of ``rows``, which adds columns ``added`` that depend on ``key`` alone, for keys that repeat often and are dear to work on.

    The values of ``MEMO`` rows are worked on once and looked up by all rows; a row whose value isn't among them is worked on itself. So rows are neither dealt by key,
    which would put all rows of a frequent value in one task, nor made a second time for a list of all values, and what is sent to tasks is bounded.
    """
    few = made(rows.select(key).limit(MEMO).distinct()).select(F.col(key).alias("__key"), F.struct(*added).alias("__made"))
    joined = rows.join(F.broadcast(few), F.col(key) == F.col("__key"), "left").drop("__key")
    own = made(joined.withColumn("__own", F.col(key)).withColumn(key, F.when(F.col("__made").isNull(), F.col(key))))
    others = [F.col("__own").alias(c) if c == key else F.col(c) for c in rows.columns]
    return own.select(*others, *[F.when(F.col("__made").isNull(), F.col(c)).otherwise(F.col(f"__made.{c}")).alias(c) for c in added])


def measures(*rows: tuple[str | Column, str | Column, int | Column]) -> Column:
    """Rows (measure, value, n) made of one row, exploded as ``x``; text that is no column is itself."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.explode(F.array(*[F.struct(of(m).alias("measure"), of(v).cast("string").alias("value"), of(n).cast("long").alias("n")) for m, v, n in rows])).alias("x")
