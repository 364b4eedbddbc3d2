"""Retail dashboard KPIs over cleaned transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import order_bucket, percent


def _invoices(clean: DataFrame, *keys: str) -> DataFrame:
    """Revenue and units per invoice and customer.

    Counting two kinds of distinct values triples the rows; after this step there
    is one row per invoice to triple instead of one per line.
    """
    return clean.groupBy(*keys, "InvoiceNo", "CustomerID").agg(
        F.sum("TotalPrice").alias("revenue"), F.sum(F.col("Quantity").cast("bigint")).alias("units")
    )


def _kpis() -> list[Column]:
    revenue = F.sum("revenue").cast("double")
    orders = F.countDistinct("InvoiceNo")
    return [
        revenue.alias("revenue"),
        orders.alias("orders"),
        F.countDistinct("CustomerID").alias("customers"),
        F.sum("units").alias("units"),
        F.try_divide(revenue, orders).alias("aov"),
    ]


def month_key() -> Column:
    """Sortable month number, such as 201111."""
    return (F.year("InvoiceDate") * 100 + F.month("InvoiceDate")).cast("int")


def dashboard_filter(
    clean: DataFrame, countries: Sequence[str] | None = None, months: Sequence[int] | None = None
) -> DataFrame:
    """Limit a dashboard to countries and months given as yyyymm.

    A month becomes a range of instants, which the scan can use to skip data.
    """
    kept = clean
    if countries is not None:
        kept = kept.filter(F.col("Country").isin(list(countries)))
    if months is not None:
        spans = F.lit(False)
        for month in months:
            start = F.lit(f"{month // 100:04d}-{month % 100:02d}-01 00:00:00").cast("timestamp_ntz")
            end = start + F.expr("INTERVAL 1 MONTH")
            spans = spans | ((F.col("InvoiceDate") >= start) & (F.col("InvoiceDate") < end))
        kept = kept.filter(spans)
    return kept


def retail_kpis(clean: DataFrame) -> DataFrame:
    """Revenue, distinct orders and customers, units and average order value."""
    return _invoices(clean).agg(*_kpis())


def revenue_by_month(clean: DataFrame) -> DataFrame:
    """The KPIs per month, with a label and a sortable key."""
    keyed = clean.withColumns(
        {"month_key": month_key(), "month_year": F.date_format("InvoiceDate", "MMM yyyy")}
    )
    months = _invoices(keyed, "month_key", "month_year").groupBy("month_key", "month_year")
    return months.agg(*_kpis()).orderBy("month_key")


def revenue_by_country(clean: DataFrame) -> DataFrame:
    """Revenue and its share of the total per country."""
    totals = clean.groupBy("Country").agg(F.sum("TotalPrice").alias("total"))
    return totals.select(
        "Country",
        F.col("total").cast("double").alias("revenue"),
        percent(F.col("total"), _everything(totals)).alias("share_pct"),
    )


def _everything(totals: DataFrame) -> Column:
    """The grand total of grouped totals: it reuses their shuffle, not another scan."""
    return totals.agg(F.sum("total").cast("double")).scalar()


def _product_totals(clean: DataFrame) -> DataFrame:
    """Revenue per product.

    Lines are dealt out by product first, or every task that read some of them
    would hold a sum for nearly the whole catalogue, beside what its joins hold.
    A product's lines go to up to four tasks, which add them up before they meet.
    """
    part = F.pmod(F.hash("InvoiceNo"), F.lit(4))
    dealt = clean.select("StockCode", "TotalPrice", part.alias("part")).repartition("StockCode", "part")
    totals = dealt.groupBy("StockCode").agg(F.sum("TotalPrice").alias("total"))
    return totals.withColumn("revenue", F.col("total").cast("double"))


def top_products(clean: DataFrame, count: int = 10) -> DataFrame:
    """The best-selling products with their share and running share of revenue."""
    products = _product_totals(clean)
    best = products.orderBy(F.desc("total"), "StockCode").limit(count)
    running = Window.partitionBy(F.lit(0)).orderBy(F.desc("total"), "StockCode")
    return (
        best.withColumn("position", F.row_number().over(running))
        .withColumn("running", F.sum("total").over(running))
        .withColumn("everything", _everything(products))
        .select(
            "position",
            "StockCode",
            "revenue",
            percent(F.col("revenue"), F.col("everything")).alias("share_pct"),
            percent(F.col("running"), F.col("everything")).alias("running_share_pct"),
        )
    )


def product_concentration(clean: DataFrame) -> DataFrame:
    """Every product with the revenue share of all products that sell at least as much.

    Products of equal revenue share one rank and one running share. The running
    sums go over distinct revenues in two steps, buckets first and values inside
    a bucket second, so no task sorts the whole catalogue.
    """
    products = _product_totals(clean)
    values = (
        products.groupBy("revenue")
        .agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("products"))
        .withColumn("bucket", order_bucket(F.col("revenue")))
    )
    descending = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    buckets = (
        values.groupBy("bucket")
        .agg(F.sum("total").alias("bucket_total"), F.sum("products").alias("bucket_products"))
        .select(
            "bucket",
            (F.sum("bucket_total").over(descending) - F.col("bucket_total")).alias("above"),
            (F.sum("bucket_products").over(descending) - F.col("bucket_products")).alias("ahead"),
        )
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("revenue"))
    ranked = values.join(buckets, "bucket").select(
        "revenue",
        (F.col("above") + F.sum("total").over(inside)).cast("double").alias("running"),
        (F.col("ahead") + F.sum("products").over(inside) - F.col("products") + 1).alias("rank"),
    )
    share = percent(F.col("running"), _everything(products))
    return products.join(ranked, "revenue").select(
        "StockCode", "revenue", "rank", share.alias("running_share_pct")
    )
