"""Daily and monthly sales series.

Series are keyed by an optional column such as Country; without one, a single
series named ``all`` covers everything. After the daily sum a series has one
row per calendar day, so its windows are bounded by the calendar.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import TOTAL

SERIES = "series"


def _key(column: str | None) -> Column:
    return (F.lit("all") if column is None else F.col(column)).alias(SERIES)


def daily_sales(clean: DataFrame, by: str | None = None) -> DataFrame:
    """Revenue per calendar date with sales: (series, Date, Sales)."""
    return (
        clean.select(_key(by), F.to_date("InvoiceDate").alias("Date"), "TotalPrice")
        .groupBy(SERIES, "Date")
        .agg(F.sum("TotalPrice").cast("double").alias("Sales"))
    )


def rolling_sales(daily: DataFrame, rows: int = 7) -> DataFrame:
    """Trailing mean over rows, not days; null until enough rows exist."""
    frame = Window.partitionBy(SERIES).orderBy("Date").rowsBetween(1 - rows, 0)
    full = F.count(F.lit(1)).over(frame) == rows
    mean = F.sum(F.col("Sales").cast(TOTAL)).over(frame).cast("double") / F.lit(float(rows))
    return daily.withColumn("RollingMean", F.when(full, mean))


def monthly_totals(daily: DataFrame) -> DataFrame:
    """Revenue per month end, empty months as zero, the last incomplete month dropped."""
    months = (
        daily.groupBy(SERIES, F.last_day("Date").alias("MonthEnd"))
        .agg(F.sum(F.col("Sales").cast(TOTAL)).cast("double").alias("Sales"))
    )
    first, last = F.trunc(F.min("MonthEnd"), "month"), F.trunc(F.max("MonthEnd"), "month")
    spine = (
        months.groupBy(SERIES)
        .agg(F.sequence(first, last, F.expr("INTERVAL 1 MONTH")).alias("starts"))
        .select(SERIES, F.explode(F.slice("starts", 1, F.size("starts") - 1)).alias("start"))
        .select(SERIES, F.last_day("start").alias("MonthEnd"))
    )
    return spine.join(months, [SERIES, "MonthEnd"], "left").select(
        SERIES, "MonthEnd", F.coalesce("Sales", F.lit(0.0)).alias("Sales")
    )


def monthly_sales(clean: DataFrame, by: str | None = None) -> DataFrame:
    """Monthly totals straight from sales lines."""
    return monthly_totals(daily_sales(clean, by))


def fill_days(daily: DataFrame) -> DataFrame:
    """A row for every calendar day between the first and last of each series."""
    spine = (
        daily.groupBy(SERIES)
        .agg(
            F.sequence(F.min("Date"), F.max("Date"), F.expr("INTERVAL 1 DAY")).alias("days")
        )
        .select(SERIES, F.explode("days").alias("Date"))
    )
    return spine.join(daily, [SERIES, "Date"], "left").select(
        SERIES, "Date", F.coalesce("Sales", F.lit(0.0)).alias("Sales")
    )


def holdout_split(filled: DataFrame, steps: int = 7) -> DataFrame:
    """Mark the last rows of each series as the test part."""
    latest = F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc("Date")))
    return filled.withColumn("part", F.when(latest <= steps, "test").otherwise("train"))


def window_split(filled: DataFrame, start: date, end: date) -> DataFrame:
    """Train strictly before the start, test from start to end inclusive, drop later rows."""
    inside = F.col("Date").between(F.lit(start), F.lit(end))
    return filled.filter(F.col("Date") <= F.lit(end)).withColumn(
        "part", F.when(inside, "test").otherwise("train")
    )
