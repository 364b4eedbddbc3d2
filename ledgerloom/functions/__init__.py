"""Column-level helpers shared by the operators."""

from ledgerloom.functions.columns import (
    days_between,
    half_even,
    half_up,
    line_total,
    order_bucket,
    percent,
)

__all__ = [
    "days_between",
    "half_even",
    "half_up",
    "line_total",
    "order_bucket",
    "percent",
]
