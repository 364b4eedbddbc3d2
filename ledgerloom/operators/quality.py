"""Profiling and data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import half_even
from ledgerloom.operators.quantiles import exact_quantiles, long_form, quantile_columns

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _missing(frame: DataFrame, name: str) -> Column:
    """Null, or not-a-number in a floating column."""
    kind = frame.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def dataset_profile(
    frame: DataFrame, order_by: Sequence[str], descriptions: Mapping[str, str]
) -> DataFrame:
    """Type, example value and meaning of each column.

    The example is the first row of a stated order: each partition keeps its
    best row, and one row is compared per partition.
    """
    first = frame.orderBy(*order_by).limit(1)
    text = [_as_text(frame, name).alias(name) for name in frame.columns]

    def per_column(values: Mapping[str, str | None]) -> Column:
        return reduce(
            lambda rest, name: F.when(F.col("Attribute") == name, F.lit(values.get(name))).otherwise(rest),
            frame.columns,
            F.lit(None).cast("string"),
        )

    return (
        first.select(text)
        .unpivot([], frame.columns, "Attribute", "ExampleValue")
        .select(
            "Attribute",
            per_column(dict(frame.dtypes)).alias("DataType"),
            "ExampleValue",
            per_column(descriptions).alias("Description"),
        )
    )


def _as_text(frame: DataFrame, name: str) -> Column:
    kind = frame.schema[name].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return F.col(name).cast("string")


def rows_with_missing(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a missing value in any of the columns (all by default)."""
    return frame.filter(reduce(or_, [_missing(frame, name) for name in columns or frame.columns]))


def missing_counts(frame: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    counted = frame.agg(*[F.count_if(_missing(frame, name)).alias(name) for name in frame.columns])
    return counted.unpivot([], frame.columns, "Column", "MissingCount")


def summary_statistics(frame: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """count, mean, sample deviation, extremes and exact quartiles, one row per feature."""
    moments = (
        long_form(frame, columns)
        .groupBy("feature")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    quartiles = quantile_columns(exact_quantiles(frame, columns, list(QUARTILES.values())), QUARTILES)
    # Both sides have one row per listed feature.
    joined = moments.join(F.broadcast(quartiles), "feature")
    rounded = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return joined.select(
        "feature", "count", *[half_even(F.col(name), digits).alias(name) for name in rounded]
    )


def iqr_fence(frame: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row: quartiles, interquartile range and the upper fence."""
    quartiles = quantile_columns(
        exact_quantiles(frame, [column], [0.25, 0.75]), {"q1": 0.25, "q3": 0.75}
    )
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        "q1", "q3", iqr.alias("iqr"), (F.col("q3") + F.lit(factor) * iqr).alias("upper_fence")
    )


def without_outliers(frame: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows at or below the upper fence."""
    fence = iqr_fence(frame, column, factor).select("upper_fence").scalar()
    return frame.filter(F.col(column) <= fence)


def correlation_matrix(frame: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Pearson correlation of every pair, long form, from one aggregation."""
    pairs = list(combinations(columns, 2))
    one_row = frame.agg(
        *[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"{x}|{y}") for x, y in pairs],
        *[F.when(F.stddev_pop(x) > 0, F.lit(1.0)).alias(f"{x}|{x}") for x in columns],
    )
    cells = [(x, y, f"{x}|{y}") for x, y in pairs] + [(y, x, f"{x}|{y}") for x, y in pairs]
    cells += [(x, x, f"{x}|{x}") for x in columns]
    structs = [
        F.struct(
            F.lit(x).alias("feature_x"),
            F.lit(y).alias("feature_y"),
            half_even(F.col(f"`{key}`"), digits).alias("r"),
        )
        for x, y, key in cells
    ]
    return one_row.select(F.inline(F.array(*structs)))


def histograms(frame: DataFrame, bins: Mapping[str, int]) -> DataFrame:
    """Equal-width counts between each column's minimum and maximum, last bin closed.

    Only non-empty bins are returned; bounds are rounded by the caller if needed.
    """
    ranges = frame.agg(
        F.struct(
            *[F.min(name).cast("double").alias(f"{name}_low") for name in bins],
            *[F.max(name).cast("double").alias(f"{name}_high") for name in bins],
        )
    ).scalar()
    placed = frame.withColumn("_range", ranges)
    cells = []
    for name, count in bins.items():
        low = F.col(f"_range.{name}_low")
        width = (F.col(f"_range.{name}_high") - low) / F.lit(float(count))
        offset = F.coalesce(F.try_divide(F.col(name).cast("double") - low, width), F.lit(0.0))
        index = F.least(F.floor(offset), F.lit(count - 1)).cast("bigint")
        cells.append(
            F.struct(
                F.lit(name).alias("feature"),
                index.alias("bin"),
                (low + width * index).alias("bin_start"),
                F.col(name).isNotNull().alias("present"),
            )
        )
    return (
        placed.select(F.inline(F.array(*cells)))
        .filter("present")
        .groupBy("feature", "bin")
        .agg(F.min("bin_start").alias("bin_start"), F.count(F.lit(1)).alias("count"))
    )


def box_statistics(frame: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the furthest points inside the fences, and flier counts."""
    quartiles = quantile_columns(
        exact_quantiles(frame, [column], list(QUARTILES.values())), QUARTILES
    ).select(F.struct(*QUARTILES).alias("box"))
    value = F.col(column).cast("double")
    reach = F.lit(factor) * (F.col("box.q75") - F.col("box.q25"))
    low, high = F.col("box.q25") - reach, F.col("box.q75") + reach
    inside = (value >= low) & (value <= high)
    return frame.withColumn("box", quartiles.scalar()).agg(
        F.lit(column).alias("feature"),
        F.min("box.q25").alias("q25"),
        F.min("box.q50").alias("median"),
        F.min("box.q75").alias("q75"),
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if(value < low).alias("fliers_low"),
        F.count_if(value > high).alias("fliers_high"),
    )
