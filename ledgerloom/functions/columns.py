"""Expressions with one agreed meaning across the library.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
# Room for totals that are summed again, and for means of any feature.
TOTAL = "decimal(28,4)"
FEATURE = "decimal(28,10)"
# Removes binary noise before rounding; a double beyond it has no digits to round.
ROUNDING = "decimal(38,14)"
# Buckets per factor e in order_bucket: neighbouring buckets are 0.025 % apart.
BUCKETS_PER_E = 4096


def line_total(quantity: Column, unit_price: Column) -> Column:
    """Quantity x price as an exact decimal, so sums do not depend on row order."""
    return (quantity * unit_price.cast(MONEY)).cast(MONEY)


def days_between(start: Column, end: Column) -> Column:
    """Whole elapsed 24-hour days (not calendar days) from start to a later end.

    The difference of two zone-less instants is an interval, so neither the
    session time zone nor its daylight saving changes the result.
    """
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def half_even(value: Column, digits: int) -> Column:
    """Round to the nearest even neighbour, as data-frame libraries do."""
    return F.coalesce(F.bround(value.try_cast(ROUNDING), digits).cast("double"), value.cast("double"))


def half_up(value: Column, digits: int) -> Column:
    """Round half away from zero, as SQL ROUND does."""
    return F.coalesce(F.round(value.try_cast(ROUNDING), digits).cast("double"), value.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double; null where the denominator is zero."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def order_bucket(value: Column) -> Column:
    """Map a double to an integer bucket that preserves order.

    Logarithmic, so heavy-tailed values spread over many buckets, and a pure
    function of the value, so a recomputed task always agrees with the first run.
    """
    magnitude = F.floor(F.log1p(F.abs(value)) * F.lit(float(BUCKETS_PER_E)))
    return F.when(value < 0, -magnitude - F.lit(1)).otherwise(magnitude).cast("int")
