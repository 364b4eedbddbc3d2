"""Joins whose keys may be very common on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: str, parts: int = 16) -> DataFrame:
    """A left join in which the rows of a common key go to several tasks.

    ``few`` has at most one row per key and only keys worth joining; it is
    repeated ``parts`` times. ``by`` names a column of ``many`` that differs
    among the rows of a key.
    """
    salted = many.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)))
    repeated = few.withColumn("_part", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(parts)])))
    return salted.join(repeated, [*on, "_part"], "left").drop("_part")
