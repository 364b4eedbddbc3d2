"""Exact quantiles without gathering a column in one task.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here the values are counted, the counts are summed into
order-preserving buckets, and only the buckets that hold a wanted rank are
sorted. The bucket table has a fixed maximum size whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import order_bucket


def long_form(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per non-null value: (feature, value)."""
    typed = frame.select([F.col(name).cast("double").alias(name) for name in columns])
    return typed.unpivot([], list(columns), "feature", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def _bucketed(counts: DataFrame, steps: int = 1 << 16) -> DataFrame:
    """Add the bucket of each value, by its size and by its place in the feature's range.

    Both parts grow with the value. Heavy-tailed columns spread by the first,
    narrow ones far from zero by the second.
    """
    # One row per feature.
    ranges = counts.groupBy("feature").agg(
        F.min("value").alias("_low"), (F.max("value") - F.min("value")).alias("_width")
    )
    place = F.try_divide(F.col("value") - F.col("_low"), F.col("_width"))
    linear = F.coalesce(F.floor(F.when(F.abs("_width") < float("inf"), place) * (steps - 1)), F.lit(0))
    return (
        counts.join(F.broadcast(ranges), "feature")
        .withColumn("bucket", order_bucket(F.col("value")).cast("bigint") * steps + linear)
        .drop("_low", "_width")
    )


def exact_quantiles(
    frame: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Linearly interpolated quantiles as rows (feature, probability, value)."""
    counts = (
        long_form(frame, columns)
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    counts = _bucketed(counts)
    running = Window.partitionBy("feature").orderBy("bucket")
    buckets = (
        counts.groupBy("feature", "bucket")
        .agg(F.sum("copies").alias("copies"))
        .withColumn("rows", F.sum("copies").over(Window.partitionBy("feature")))
        .withColumn("before", F.sum("copies").over(running) - F.col("copies"))
    )
    # Two ranks per feature and probability: a size set by the arguments alone.
    position = (F.col("rows") - 1) * F.col("probability")
    wanted = (
        buckets.withColumn("probability", F.explode(F.array([F.lit(float(p)) for p in probabilities])))
        .withColumn("position", position)
        .withColumn("rank", F.explode(F.array(F.floor("position"), F.ceil("position"))))
        .filter(
            (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("copies"))
        )
        .select("feature", "bucket", "before", "probability", "position", "rank")
        .distinct()
    )
    inside = Window.partitionBy("feature", "probability", "rank").orderBy("value")
    located = (
        counts.join(F.broadcast(wanted), ["feature", "bucket"])
        .withColumn("upto", F.col("before") + F.sum("copies").over(inside))
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("copies")))
    )
    fraction = F.col("position") - F.floor("position")
    return (
        located.groupBy("feature", "probability", "position")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .select(
            "feature",
            "probability",
            (F.col("low") + (F.col("high") - F.col("low")) * fraction).alias("value"),
        )
    )


def quantile_columns(quantiles: DataFrame, names: dict[str, float]) -> DataFrame:
    """Turn quantile rows into one row per feature with the named columns."""
    picks: list[Column] = [
        F.max(F.when(F.col("probability") == F.lit(float(p)), F.col("value"))).alias(name)
        for name, p in names.items()
    ]
    return quantiles.groupBy("feature").agg(*picks)


def quantile_segments(frame: DataFrame, column: str, parts: int, label: str = "segment") -> DataFrame:
    """Label rows 0..parts-1 by quantile of a column, the highest values first.

    The cut points form an array of parts-1 numbers, read as a scalar subquery.
    """
    cuts = exact_quantiles(frame, [column], [i / parts for i in range(1, parts)]).agg(
        F.array_agg("value").alias("cuts")
    )
    above = F.size(F.filter(F.col("_cuts"), lambda cut: F.col(column) < cut))
    return frame.withColumn("_cuts", cuts.scalar()).withColumn(label, above).drop("_cuts")
