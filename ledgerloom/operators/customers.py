"""Customer features: recency, frequency, monetary value and buying behaviour.

Each feature first collapses transactions to one row per invoice, product or
day of a customer. The rows that meet under one customer are then bounded by
the calendar or already counted, so a customer with a third of all sales does
not gather them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import days_between
from ledgerloom.functions.columns import MONEY

RFM = ["Recency", "Frequency", "Monetary"]
EXTENDED = RFM + ["AvgPurchaseValue", "ProductDiversity", "AvgDaysBetweenTransactions"]


def snapshot(clean: DataFrame) -> DataFrame:
    """One row: the reference instant, a day after the last sale."""
    return clean.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("snapshot"))


def _snapshot_of(grouped: DataFrame) -> Column:
    """The snapshot of sales already grouped, taken from the shuffle of that grouping.

    Asking for the maximum of every column keeps this copy of the plan as wide
    as the main one, so both share one exchange and the sales are scanned once.
    """
    columns = [name for name in grouped.columns if name != "CustomerID"]
    widest = grouped.agg(F.struct(*[F.max(name).alias(name) for name in columns]))
    return widest.scalar().getField("LastLine") + F.expr("INTERVAL 1 DAY")


def invoices(clean: DataFrame) -> DataFrame:
    """One row per customer and invoice."""
    return clean.groupBy("CustomerID", "InvoiceNo").agg(
        F.min("InvoiceDate").alias("FirstLine"),
        F.max("InvoiceDate").alias("LastLine"),
        F.sum("TotalPrice").alias("Total"),
    )


def rfm(clean: DataFrame) -> DataFrame:
    """Recency in whole days, distinct invoices and total spend per customer."""
    totals = invoices(clean).groupBy("CustomerID").agg(
        F.max("LastLine").alias("LastLine"),
        F.count(F.lit(1)).alias("Frequency"),
        F.sum("Total").cast("double").alias("Monetary"),
    )
    recency = days_between(F.col("LastLine"), _snapshot_of(totals))
    return totals.select("CustomerID", recency.alias("Recency"), "Frequency", "Monetary")


def average_purchase_value(clean: DataFrame) -> DataFrame:
    """Spend per distinct invoice."""
    return invoices(clean).groupBy("CustomerID").agg(
        (F.sum("Total").cast("double") / F.count(F.lit(1))).alias("AvgPurchaseValue")
    )


def product_diversity(clean: DataFrame) -> DataFrame:
    """Distinct products per customer."""
    return (
        clean.select("CustomerID", "StockCode")
        .distinct()
        .groupBy("CustomerID")
        .agg(F.count(F.lit(1)).alias("ProductDiversity"))
    )


def _by_day(orders: DataFrame) -> DataFrame:
    """One row per customer and active day.

    Rows without a first line fall into a day of their own, null, which sorts
    first and has no last invoice to measure a gap from.
    """
    return (
        orders.withColumn("Day", F.to_date("FirstLine"))
        .groupBy("CustomerID", "Day")
        .agg(
            F.min("FirstLine").alias("DayFirst"),
            F.max("FirstLine").alias("DayLast"),
            F.max("LastLine").alias("LastLine"),
            F.count("FirstLine").alias("Invoices"),
            F.sum("Total").alias("Total"),
            F.count(F.lit(1)).alias("Rows"),
        )
    )


def _with_gaps(days: DataFrame) -> DataFrame:
    """Add the whole days since the customer's active day before.

    A gap inside one calendar day is under 24 hours, hence zero whole days, so
    only these gaps add to the sum over all invoices.
    """
    previous = F.lag("DayLast").over(Window.partitionBy("CustomerID").orderBy("Day"))
    return days.withColumn("PreviousLast", previous).withColumn(
        "Gap", days_between(F.col("PreviousLast"), F.col("DayFirst"))
    )


def _mean_gap() -> Column:
    """Mean of all gaps from per-day sums; zero for a single invoice."""
    gaps = F.sum("Invoices") - 1
    return F.coalesce(F.try_divide(F.sum("Gap").cast("double"), gaps), F.lit(0.0))


def average_days_between(clean: DataFrame) -> DataFrame:
    """Mean whole days between consecutive invoices; zero for a single invoice."""
    return (
        _with_gaps(_by_day(invoices(clean)))
        .groupBy("CustomerID")
        .agg(_mean_gap().alias("AvgDaysBetweenTransactions"))
    )


def invoice_gaps(clean: DataFrame) -> DataFrame:
    """Every invoice with the whole days since the same customer's previous one.

    The lag runs per customer and day; the first invoice of a day takes its
    predecessor from the per-day table, so no window spans a whole customer.
    """
    orders = invoices(clean)
    within = Window.partitionBy("CustomerID", "Day").orderBy("FirstLine", "InvoiceNo")
    carried = _with_gaps(_by_day(orders)).select("CustomerID", "Day", "PreviousLast")
    return (
        orders.withColumn("Day", F.to_date("FirstLine"))
        .withColumn("Previous", F.lag("FirstLine").over(within))
        .join(carried, ["CustomerID", "Day"])
        .select(
            "CustomerID",
            "InvoiceNo",
            F.col("FirstLine").alias("InvoiceDate"),
            days_between(
                F.coalesce("Previous", "PreviousLast"), F.col("FirstLine")
            ).alias("DaysBetweenTransactions"),
        )
    )


def _invoices_and_products(clean: DataFrame) -> DataFrame:
    """One row per customer and invoice, and one per customer and product, in one scan.

    Product rows carry the key only: no dates and no amount.
    """
    line = F.array(
        F.struct(
            F.lit(True).alias("is_invoice"),
            F.col("InvoiceNo").alias("key"),
            F.col("InvoiceDate").alias("at"),
            F.col("TotalPrice").alias("amount"),
        ),
        F.struct(
            F.lit(False).alias("is_invoice"),
            F.col("StockCode").alias("key"),
            F.lit(None).cast("timestamp_ntz").alias("at"),
            F.lit(None).cast(MONEY).alias("amount"),
        ),
    )
    return (
        clean.select("CustomerID", F.inline(line))
        .groupBy("CustomerID", "is_invoice", "key")
        .agg(
            F.min("at").alias("FirstLine"),
            F.max("at").alias("LastLine"),
            F.sum("amount").alias("Total"),
        )
    )


def customer_features(clean: DataFrame) -> DataFrame:
    """All six features in one pass over the sales, without a join.

    Invoices and products of a customer are told apart by a tag, counted per
    day, and folded per customer.
    """
    invoice_count = F.sum("Invoices")
    spend = F.sum("Total").cast("double")
    recency = days_between(F.max("LastLine"), F.first("snapshot"))
    days = _by_day(_invoices_and_products(clean))
    return (
        _with_gaps(days)
        .withColumn("snapshot", _snapshot_of(days))
        .groupBy("CustomerID")
        .agg(
            recency.alias("Recency"),
            invoice_count.alias("Frequency"),
            spend.alias("Monetary"),
            (spend / invoice_count).alias("AvgPurchaseValue"),
            (F.sum("Rows") - invoice_count).alias("ProductDiversity"),
            _mean_gap().alias("AvgDaysBetweenTransactions"),
        )
    )


def capped(features: DataFrame, frequency: int = 50, monetary: float = 25000.0) -> DataFrame:
    """Customers at or below both limits."""
    return features.filter((F.col("Frequency") <= frequency) & (F.col("Monetary") <= monetary))


def log_features(features: DataFrame, columns: list[str]) -> DataFrame:
    """Add log(1 + x) of each column under a ``_log`` name."""
    return features.withColumns({f"{name}_log": F.log1p(name) for name in columns})
