"""Transaction cleaning."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import line_total

# The columns a sale must have.
REQUIRED = ["CustomerID", "InvoiceNo", "StockCode", "InvoiceDate"]


def _whole_number(number: Column, kind: T.DataType) -> Column:
    """The text of an id that may have been read as a number: 17850.0 and 1.785E4 are 17850.

    An id that is no number at all, or not a number in the floating sense, is null.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = F.when(~F.isnan(number), number)
    elif isinstance(kind, T.StringType):
        number = number.try_cast("decimal(38,10)")
    return number.cast("bigint").cast("string")


def clean_transactions(transactions: DataFrame) -> DataFrame:
    """Keep completed sales of known customers and add the line total.

    Every predicate is a plain comparison, so all of them reach the scan; a
    drop-nulls call would become one expression that no file reader can use.
    """
    known = reduce(and_, [F.col(name).isNotNull() for name in REQUIRED])
    customer = transactions.schema["CustomerID"].dataType
    cleaned = (
        transactions.filter(known)
        .filter(~F.startswith("InvoiceNo", F.lit("C")))
        .filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))
        .withColumn("CustomerID", _whole_number(F.col("CustomerID"), customer))
        .withColumn("TotalPrice", line_total(F.col("Quantity"), F.col("UnitPrice")))
    )
    if isinstance(customer, (T.DoubleType, T.FloatType, T.StringType)):
        cleaned = cleaned.filter(F.col("CustomerID").isNotNull())
    return cleaned
