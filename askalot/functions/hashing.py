"""Order keys: what a seeded random draw is here. Equal in Spark and in SQL, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by '|'; plain strings and numbers are literals."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def respondent_seed(seed: int, respondent_id: Column) -> Column:
    """The first 32 bits of sha256('{seed}_{id}')."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}_"), respondent_id), 256), 1, 8), 16, 10).cast("long")
