"""Employee attrition KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import half_up, percent


def _measures() -> list[Column]:
    departures = F.count_if(F.col("attrition"))
    return [
        F.count(F.lit(1)).alias("employees"),
        departures.alias("departures"),
        half_up(percent(departures, F.count(F.lit(1))), 2).alias("attrition_pct"),
    ]


def attrition_overall(employees: DataFrame) -> DataFrame:
    return employees.agg(*_measures())


def attrition_by_dimension(
    employees: DataFrame, dimensions: Sequence[str] = ("department", "overtime", "job_role")
) -> DataFrame:
    """Departures and rate per value of each dimension, all dimensions in one pass."""
    keys = list(dimensions)
    texts = employees.withColumns({name: F.col(name).cast("string") for name in keys})
    grouped = texts.groupingSets([[F.col(name)] for name in keys], *keys).agg(
        *_measures(), *[F.grouping(name).alias(f"_{name}") for name in keys]
    )
    named = F.coalesce(*[F.when(F.col(f"_{name}") == 0, F.lit(name)) for name in keys])
    value = F.coalesce(*keys)
    return grouped.select(
        named.alias("dimension"), value.alias("value"), "employees", "departures", "attrition_pct"
    )


def attrition_by_tenure(employees: DataFrame, early_years: int = 5) -> DataFrame:
    """Departures in the first years of employment against later ones."""
    band = F.when(F.col("years_at_company") <= early_years, f"first {early_years} years").otherwise(
        f"after {early_years} years"
    )
    return employees.groupBy(band.alias("tenure_band")).agg(*_measures())
