"""Every query by name: ``callable(spark, folder) -> DataFrame``.

A query wires an adapter view to operators. Results keep to types that any SQL
engine prints alike: dates and instants as text, decimals as doubles, integers
as bigint, lists as sorted text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import half_even
from ledgerloom.operators import (
    attrition,
    baskets,
    bestrules,
    cleaning,
    customers,
    density,
    forecast,
    likelihood,
    projection,
    quality,
    regression,
    retail,
    revenue,
    scaling,
    scores,
    segments,
    timeseries,
)
from ledgerloom.operators.quantiles import quantile_segments
from ledgerloom.session import materialise, scratch_path
from ledgerloom.sources import schemas, tables, workbook
from ledgerloom.sources.adapters import view

Query = Callable[[SparkSession, str], DataFrame]

# Parameters chosen for the value ranges of the adapter views.
FREQUENCY_LIMIT, MONETARY_LIMIT = 15, 1_200_000.0
BACKTEST_START, BACKTEST_END = date(2000, 8, 14), date(2000, 8, 20)
DASHBOARD_COUNTRY, DASHBOARD_MONTH = "NATION_1", 199811
STAGES = ["Won", "Lost", "Active A", "Active B"]
DENSITY_EPS = 0.15
PROFILE_ORDER = ["InvoiceDate", "InvoiceNo", "StockCode", "Quantity", "UnitPrice"]
HISTOGRAM_BINS = {
    "Monetary": 100,
    "Recency": 50,
    "Frequency": 75,
    "ProductDiversity": 75,
    "AvgPurchaseValue": 75,
}

QUERIES: dict[str, Query] = {}


def portable(frame: DataFrame) -> DataFrame:
    """Reduce column types to text, bigint, double and boolean."""
    columns = []
    for field in frame.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            column = F.concat_ws(", ", F.array_sort(column))
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register a function of Inputs under its own name."""
    QUERIES[build.__name__] = lambda spark, folder: portable(build(Inputs(spark, folder)))
    return build


class Inputs:
    """The views and shared steps of one run."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    @property
    def clean(self) -> DataFrame:
        return cleaning.clean_transactions(self.view("transactions"))

    @property
    def features(self) -> DataFrame:
        return customers.customer_features(self.clean)

    @property
    def rfm(self) -> DataFrame:
        return customers.rfm(self.clean)

    @property
    def rfm_table(self) -> DataFrame:
        """Written out, for queries that read it several times: one row per customer."""
        return materialise(self.rfm, "rfm")

    @property
    def feature_table(self) -> DataFrame:
        return materialise(self.features, "features")

    def segmented(self, features: DataFrame, parts: int = 3) -> DataFrame:
        return quantile_segments(features, "Monetary", parts)

    def rfm_points(self, features: DataFrame | None = None) -> DataFrame:
        return segments.model_space(self.rfm_table if features is None else features, customers.RFM)

    @property
    def extended_points(self) -> DataFrame:
        return segments.model_space(self.feature_table, customers.EXTENDED)

    @property
    def items(self) -> DataFrame:
        clean = self.clean
        labels = self.segmented(self.rfm_table).select("CustomerID", "segment")
        return baskets.basket_items(clean, labels)

    @property
    def rules(self) -> DataFrame:
        return baskets.association_rules(baskets.frequent_itemsets(self.items))

    def filled(self, by: str | None = None) -> DataFrame:
        """Daily series without gaps, written out: at most one row per day and series."""
        daily = materialise(timeseries.daily_sales(self.clean, by), "daily")
        return timeseries.fill_days(daily)

    def holdout(self, by: str | None = None) -> tuple[DataFrame, DataFrame]:
        return _parts(timeseries.holdout_split(self.filled(by)))

    def backtest(self) -> tuple[DataFrame, DataFrame]:
        return _parts(timeseries.window_split(self.filled(), BACKTEST_START, BACKTEST_END))


def _parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        split.filter(F.col("part") == "train").drop("part"),
        split.filter(F.col("part") == "test").drop("part"),
    )


def _rounded(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    return frame.withColumns({name: half_even(F.col(name), digits) for name in names})


RFM_SCALED = segments.scaled_names(customers.RFM)
EXTENDED_SCALED = segments.scaled_names(customers.EXTENDED)

# --- sources, sinks, quality -------------------------------------------------


@query
def load_transactions(run: Inputs) -> DataFrame:
    path = scratch_path(run.spark, "transactions")
    run.view("transactions").write.parquet(path)
    return tables.load_transactions(run.spark, path)


@query
def load_workbooks(run: Inputs) -> DataFrame:
    path = scratch_path(run.spark, "workbooks")
    spread = run.view("transactions").repartition(run.spark.sparkContext.defaultParallelism)
    workbook.write_workbooks(spread, path)
    return tables.load_transactions(run.spark, path, workbook.FORMAT)


@query
def sink_csv(run: Inputs) -> DataFrame:
    summary = segments.cluster_summary(run.segmented(run.rfm_table), "segment", customers.RFM)
    path = scratch_path(run.spark, "summary-csv")
    tables.write_csv(summary, path)
    return tables.read_csv(run.spark, path, summary.schema)


@query
def sink_partitioned(run: Inputs) -> DataFrame:
    labelled = run.segmented(run.rfm_table)
    path = scratch_path(run.spark, "by-segment")
    tables.write_partitioned(labelled, path, ["segment"])
    return run.spark.read.schema(labelled.schema).parquet(path).select(labelled.columns)


@query
def dataset_profile(run: Inputs) -> DataFrame:
    return quality.dataset_profile(
        run.view("transactions"), PROFILE_ORDER, schemas.TRANSACTION_DESCRIPTIONS
    )


@query
def rows_with_missing(run: Inputs) -> DataFrame:
    return quality.rows_with_missing(run.view("transactions"))


@query
def rows_missing_customer(run: Inputs) -> DataFrame:
    return quality.rows_with_missing(run.view("transactions"), ["CustomerID"])


@query
def missing_counts(run: Inputs) -> DataFrame:
    return quality.missing_counts(run.view("transactions"))


@query
def rfm_stats(run: Inputs) -> DataFrame:
    return quality.summary_statistics(run.rfm_table, customers.RFM)


@query
def extended_stats(run: Inputs) -> DataFrame:
    return quality.summary_statistics(run.feature_table, customers.EXTENDED)


@query
def iqr_fence(run: Inputs) -> DataFrame:
    fence = quality.iqr_fence(run.rfm_table, "Monetary")
    return _rounded(fence, 4, "q1", "q3", "iqr", "upper_fence")


@query
def rfm_without_outliers(run: Inputs) -> DataFrame:
    return quality.without_outliers(run.rfm_table, "Monetary")


@query
def rfm_correlation(run: Inputs) -> DataFrame:
    return quality.correlation_matrix(run.rfm, customers.RFM)


@query
def feature_histograms(run: Inputs) -> DataFrame:
    return _rounded(quality.histograms(run.feature_table, HISTOGRAM_BINS), 4, "bin_start")


@query
def monetary_box_stats(run: Inputs) -> DataFrame:
    return _rounded(quality.box_statistics(run.rfm_table, "Monetary"), 4, "q25", "median", "q75")


# --- cleaning and customer features ------------------------------------------


@query
def clean_transactions(run: Inputs) -> DataFrame:
    return run.clean


@query
def rfm(run: Inputs) -> DataFrame:
    return run.rfm


@query
def avg_purchase_value(run: Inputs) -> DataFrame:
    return customers.average_purchase_value(run.clean)


@query
def product_diversity(run: Inputs) -> DataFrame:
    return customers.product_diversity(run.clean)


@query
def invoice_gaps(run: Inputs) -> DataFrame:
    gaps = customers.invoice_gaps(run.clean)
    # As a double: a customer's first invoice has no gap.
    return gaps.withColumn(
        "DaysBetweenTransactions", F.col("DaysBetweenTransactions").cast("double")
    )


@query
def avg_days_between(run: Inputs) -> DataFrame:
    return customers.average_days_between(run.clean)


@query
def customer_features(run: Inputs) -> DataFrame:
    return run.features


@query
def customers_capped(run: Inputs) -> DataFrame:
    return customers.capped(run.features, FREQUENCY_LIMIT, MONETARY_LIMIT)


@query
def rfm_log(run: Inputs) -> DataFrame:
    logs = [f"{name}_log" for name in customers.RFM]
    return _rounded(customers.log_features(run.rfm, customers.RFM), 6, *logs)


@query
def scaled_features(run: Inputs) -> DataFrame:
    logs = [f"{name}_log" for name in customers.EXTENDED]
    names = [f"{name}_scaled" for name in [*customers.RFM, *logs]]
    logged = customers.log_features(run.feature_table, customers.EXTENDED)
    scaled = scaling.standardise(logged, [*customers.RFM, *logs])
    return _rounded(scaled.select("CustomerID", *names), 6, *names)


# --- sales pipeline ----------------------------------------------------------


@query
def total_revenue_won(run: Inputs) -> DataFrame:
    return revenue.total_revenue_won(run.view("sales_pipeline"))


@query
def total_opportunities(run: Inputs) -> DataFrame:
    return revenue.total_opportunities(run.view("sales_pipeline"))


@query
def win_rate(run: Inputs) -> DataFrame:
    return revenue.win_rate(run.view("sales_pipeline"))


@query
def closed_win_rate(run: Inputs) -> DataFrame:
    return revenue.closed_win_rate(run.view("sales_pipeline"))


@query
def stage_counts(run: Inputs) -> DataFrame:
    return revenue.stage_counts(run.view("sales_pipeline"))


@query
def avg_won_deal(run: Inputs) -> DataFrame:
    return revenue.average_won_deal(run.view("sales_pipeline"))


@query
def active_pipeline(run: Inputs) -> DataFrame:
    return revenue.active_pipeline(run.view("sales_pipeline"))


@query
def revenue_by_sector(run: Inputs) -> DataFrame:
    return revenue.revenue_by_sector(run.view("sales_pipeline"), run.view("accounts"))


@query
def revenue_by_product(run: Inputs) -> DataFrame:
    return revenue.revenue_by_product(run.view("sales_pipeline"))


@query
def revenue_by_manager(run: Inputs) -> DataFrame:
    return revenue.revenue_by_manager(run.view("sales_pipeline"), run.view("sales_teams"))


@query
def opportunity_explorer(run: Inputs) -> DataFrame:
    return revenue.explore(
        run.view("sales_pipeline"),
        run.view("sales_teams"),
        managers=["Manager#1", "Manager#2"],
        products=["1-URGENT", "2-HIGH"],
        stages=["Won", "Active A"],
    )


@query
def pipeline_pivot(run: Inputs) -> DataFrame:
    wide = revenue.pipeline_pivot(run.view("sales_pipeline"), STAGES)
    return wide.toDF(*[name.replace(" ", "_") for name in wide.columns])


# --- retail and attrition dashboards -----------------------------------------


@query
def retail_kpis(run: Inputs) -> DataFrame:
    return retail.retail_kpis(run.clean)


@query
def retail_kpis_filtered(run: Inputs) -> DataFrame:
    country = retail.retail_kpis(retail.dashboard_filter(run.clean, countries=[DASHBOARD_COUNTRY]))
    month = retail.retail_kpis(retail.dashboard_filter(run.clean, months=[DASHBOARD_MONTH]))
    return country.withColumn("page", F.lit(DASHBOARD_COUNTRY)).unionByName(
        month.withColumn("page", F.lit(str(DASHBOARD_MONTH)))
    )


@query
def revenue_by_month_in_country(run: Inputs) -> DataFrame:
    return retail.revenue_by_month(retail.dashboard_filter(run.clean, countries=[DASHBOARD_COUNTRY]))


@query
def revenue_by_country_in_month(run: Inputs) -> DataFrame:
    kept = retail.dashboard_filter(run.clean, months=[DASHBOARD_MONTH])
    return _rounded(retail.revenue_by_country(kept), 6, "share_pct")


@query
def top_products_in_country(run: Inputs) -> DataFrame:
    kept = retail.dashboard_filter(run.clean, countries=[DASHBOARD_COUNTRY])
    return _rounded(retail.top_products(kept), 6, "share_pct", "running_share_pct")


@query
def top_products_in_month(run: Inputs) -> DataFrame:
    kept = retail.dashboard_filter(run.clean, months=[DASHBOARD_MONTH])
    return _rounded(retail.top_products(kept), 6, "share_pct", "running_share_pct")


@query
def revenue_by_month(run: Inputs) -> DataFrame:
    return retail.revenue_by_month(run.clean)


@query
def revenue_by_country(run: Inputs) -> DataFrame:
    return _rounded(retail.revenue_by_country(run.clean), 6, "share_pct")


@query
def product_concentration(run: Inputs) -> DataFrame:
    return _rounded(retail.product_concentration(run.clean), 6, "running_share_pct")


@query
def top_products(run: Inputs) -> DataFrame:
    return _rounded(retail.top_products(run.clean), 6, "share_pct", "running_share_pct")


@query
def attrition_overall(run: Inputs) -> DataFrame:
    return attrition.attrition_overall(run.view("employees"))


@query
def attrition_by_dimension(run: Inputs) -> DataFrame:
    return attrition.attrition_by_dimension(run.view("employees"))


@query
def attrition_by_tenure(run: Inputs) -> DataFrame:
    return attrition.attrition_by_tenure(run.view("employees"))


# --- time series and forecasts -----------------------------------------------


@query
def daily_sales(run: Inputs) -> DataFrame:
    return timeseries.daily_sales(run.clean)


@query
def rolling_sales(run: Inputs) -> DataFrame:
    return timeseries.rolling_sales(timeseries.daily_sales(run.clean))


@query
def monthly_sales(run: Inputs) -> DataFrame:
    return timeseries.monthly_sales(run.clean)


@query
def daily_sales_filled(run: Inputs) -> DataFrame:
    return run.filled("Country")


@query
def holdout_split(run: Inputs) -> DataFrame:
    return timeseries.holdout_split(run.filled())


@query
def backtest_window(run: Inputs) -> DataFrame:
    return timeseries.window_split(run.filled(), BACKTEST_START, BACKTEST_END)


@query
def forecast_design_sums(run: Inputs) -> DataFrame:
    train, _ = run.holdout("Country")
    lags = [f"d{i}" for i in range(1, 5)]
    sums = forecast.normal_sums(forecast.lagged_differences(train, 4), "d0", lags)
    return sums.select(
        timeseries.SERIES,
        "rows",
        *[
            half_even(F.element_at("xtx", 4 * i + j + 1) / F.lit(1e6), 2).alias(f"d{i + 1}d{j + 1}")
            for i in range(4)
            for j in range(i, 4)
        ],
        *[half_even(F.element_at("xty", i + 1) / F.lit(1e6), 2).alias(f"d0d{i + 1}") for i in range(4)],
    )


@query
def forecast_series(run: Inputs) -> DataFrame:
    train, test = run.holdout("Country")
    return forecast.forecast_comparison(test, forecast.arima_forecast(train))


@query
def forecast_metrics(run: Inputs) -> DataFrame:
    train, test = run.holdout("Country")
    compared = forecast.forecast_comparison(test, forecast.naive_forecast(train))
    return forecast.forecast_metrics(compared, "Last value", "7 Days")


@query
def forecast_metrics_arima(run: Inputs) -> DataFrame:
    train, test = run.holdout()
    compared = forecast.forecast_comparison(test, forecast.arima_forecast(train))
    return forecast.forecast_metrics(compared, "ARIMA(4,1,1)", "7 Days")


@query
def forecast_series_likelihood(run: Inputs) -> DataFrame:
    train, test = run.holdout("Country")
    return forecast.forecast_comparison(test, likelihood.likelihood_forecast(train))


@query
def arima_likelihood(run: Inputs) -> DataFrame:
    """The exact likelihood of every country's model, at the two-stage estimates and at the fit."""
    train, _ = run.holdout("Country")
    return likelihood.fit_series(train).drop("path")


@query
def forecast_metrics_likelihood(run: Inputs) -> DataFrame:
    train, test = run.holdout()
    compared = forecast.forecast_comparison(test, likelihood.likelihood_forecast(train))
    return forecast.forecast_metrics(compared, "ARIMA(4,1,1) by likelihood", "7 Days")


@query
def backtest_metrics_likelihood(run: Inputs) -> DataFrame:
    train, test = run.backtest()
    compared = forecast.forecast_comparison(test, likelihood.likelihood_forecast(train))
    return forecast.forecast_metrics(compared, "ARIMA(4,1,1) by likelihood", "7 Days")


@query
def backtest_comparison(run: Inputs) -> DataFrame:
    train, test = run.backtest()
    return forecast.forecast_comparison(test, forecast.arima_forecast(train))


@query
def backtest_metrics(run: Inputs) -> DataFrame:
    train, test = run.backtest()
    compared = forecast.forecast_comparison(test, forecast.arima_forecast(train))
    metrics = forecast.forecast_metrics(compared, "ARIMA(4,1,1)", "7 Days")
    return metrics.withColumn("ValidationPeriod", F.lit(f"{BACKTEST_START} to {BACKTEST_END}"))


# --- regression --------------------------------------------------------------


@query
def train_test_split(run: Inputs) -> DataFrame:
    return scaling.train_test_split(run.rfm_table.select("CustomerID"))


@query
def spend_regression(run: Inputs) -> DataFrame:
    return _rounded(regression.spend_regression(run.rfm_table).coefficients, 4, "coefficient")


@query
def actual_vs_predicted(run: Inputs) -> DataFrame:
    return regression.actual_vs_predicted(regression.spend_regression(run.rfm_table))


@query
def regression_metrics(run: Inputs) -> DataFrame:
    model = regression.spend_regression(run.rfm_table)
    return regression.model_report(model, "Linear Regression", regression.BASELINE)


@query
def spend_regression_capped(run: Inputs) -> DataFrame:
    kept = customers.capped(run.rfm_table, FREQUENCY_LIMIT, MONETARY_LIMIT)
    model = regression.spend_regression(kept)
    report = regression.model_report(model, "Filtered Linear Regression", regression.BASELINE)
    return report.withColumns(
        {
            "FrequencyLimit": F.lit(FREQUENCY_LIMIT),
            "MonetaryLimit": F.lit(MONETARY_LIMIT),
        }
    )


@query
def regression_comparison(run: Inputs) -> DataFrame:
    return regression.regression_comparison(run.feature_table)


# --- segmentation ------------------------------------------------------------


@query
def cluster_summary(run: Inputs) -> DataFrame:
    return segments.cluster_summary(run.segmented(run.rfm_table), "segment", customers.RFM)


@query
def cluster_summary_extended(run: Inputs) -> DataFrame:
    labelled = run.segmented(run.feature_table, 4)
    return segments.cluster_summary(labelled, "segment", customers.EXTENDED)


@query
def silhouette(run: Inputs) -> DataFrame:
    points = run.rfm_points(run.segmented(run.rfm_table))
    return _rounded(scores.silhouettes(points, RFM_SCALED, ["segment"]), 4, "silhouette")


@query
def silhouette_euclidean(run: Inputs) -> DataFrame:
    points = run.rfm_points(run.segmented(run.rfm_table))
    score = scores.euclidean_silhouettes(points, RFM_SCALED, ["segment"])
    return _rounded(score, 4, "silhouette", "standard_error")


@query
def kmeans_silhouette_euclidean(run: Inputs) -> DataFrame:
    ks = range(2, 9)
    labelled = materialise(segments.with_labels(run.rfm_points(), RFM_SCALED, ks).drop("point"), "labelled")
    score = scores.euclidean_silhouettes(labelled, RFM_SCALED, [f"cluster_{k}" for k in ks])
    return _rounded(score, 4, "silhouette", "standard_error")


@query
def davies_bouldin(run: Inputs) -> DataFrame:
    points = run.rfm_points(run.segmented(run.rfm_table))
    return _rounded(scores.davies_bouldin(points, RFM_SCALED, "segment"), 4, "davies_bouldin")


@query
def best_k(run: Inputs) -> DataFrame:
    labelled = run.rfm_table
    for parts in (2, 3, 4):
        labelled = quantile_segments(labelled, "Monetary", parts, f"parts_{parts}")
    labels = {parts: f"parts_{parts}" for parts in (2, 3, 4)}
    points = run.rfm_points(labelled)
    return segments.best_k(segments.score_labels(points, RFM_SCALED, labels, "Quantiles"))


@query
def kmeans_sweep(run: Inputs) -> DataFrame:
    return segments.kmeans_sweep(run.rfm_points(), RFM_SCALED, "KMeans_RFM")


@query
def kmeans_sweep_extended(run: Inputs) -> DataFrame:
    return segments.kmeans_sweep(run.extended_points, EXTENDED_SCALED, "KMeans_ExtendedFeatures")


@query
def best_k_kmeans(run: Inputs) -> DataFrame:
    return segments.best_k(segments.kmeans_sweep(run.rfm_points(), RFM_SCALED, "KMeans_RFM"))


@query
def segment_customers(run: Inputs) -> DataFrame:
    labelled = segments.segment_customers(run.rfm_points(), RFM_SCALED, (3, 4))
    return labelled.select("CustomerID", *customers.RFM, "cluster_3", "cluster_4")


@query
def segment_customers_extended(run: Inputs) -> DataFrame:
    labelled = segments.segment_customers(run.extended_points, EXTENDED_SCALED, (3, 4))
    return labelled.select("CustomerID", "cluster_3", "cluster_4")


def _segment_summaries(points: DataFrame, coordinates: list[str], columns: list[str]) -> DataFrame:
    labelled = segments.segment_customers(points, coordinates, (3, 4))
    parts = [
        segments.cluster_summary(labelled, f"cluster_{k}", columns)
        .withColumnRenamed(f"cluster_{k}", "cluster")
        .withColumn("Clusters", F.lit(k))
        for k in (3, 4)
    ]
    return parts[0].unionByName(parts[1])


@query
def segment_summary(run: Inputs) -> DataFrame:
    return _segment_summaries(run.rfm_points(), RFM_SCALED, customers.RFM)


@query
def segment_summary_extended(run: Inputs) -> DataFrame:
    return _segment_summaries(run.extended_points, EXTENDED_SCALED, customers.EXTENDED)


@query
def winning_summary(run: Inputs) -> DataFrame:
    labelled = segments.winning_segments(run.rfm_points(), RFM_SCALED)
    summary = segments.cluster_summary(labelled, "cluster", customers.RFM)
    return summary.withColumn("Clusters", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))


@query
def segment_without_outliers(run: Inputs) -> DataFrame:
    points = run.rfm_points(quality.without_outliers(run.rfm_table, "Monetary"))
    return segments.kmeans_sweep(points, RFM_SCALED, "KMeans_Filtered", [2])


@query
def density_cells(run: Inputs) -> DataFrame:
    cells = density.core_cells(run.rfm_points(), RFM_SCALED, DENSITY_EPS)
    return cells.groupBy("core").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("points").alias("points"),
        F.max("block_points").alias("largest_block"),
    )


def _dense(run: Inputs) -> DataFrame:
    return density.density_clusters(run.rfm_points(), RFM_SCALED, DENSITY_EPS)


@query
def density_clusters(run: Inputs) -> DataFrame:
    return _dense(run).select("CustomerID", "cluster")


@query
def density_summary(run: Inputs) -> DataFrame:
    return segments.cluster_summary(_dense(run), "cluster", customers.RFM)


@query
def density_silhouette(run: Inputs) -> DataFrame:
    return _rounded(density.density_silhouette(_dense(run), RFM_SCALED), 3, "silhouette")


@query
def pca_projection(run: Inputs) -> DataFrame:
    projected = projection.pca_projection(run.rfm_points(), ["CustomerID", "Monetary"])
    return _rounded(projected, 4, "PC1", "PC2")


# --- baskets -----------------------------------------------------------------


@query
def basket_items(run: Inputs) -> DataFrame:
    return run.items


@query
def frequent_itemsets(run: Inputs) -> DataFrame:
    return baskets.frequent_itemsets(run.items)


def _coarse_items(run: Inputs) -> DataFrame:
    """Items by groups of brands, of which baskets hold three and more."""
    group = F.concat(F.lit("Group#"), F.substring("item", 7, 9).cast("int") % 6)
    return run.items.select("segment", "InvoiceNo", group.alias("item")).distinct()


@query
def frequent_itemsets_deep(run: Inputs) -> DataFrame:
    return baskets.frequent_itemsets(_coarse_items(run))


@query
def association_rules_deep(run: Inputs) -> DataFrame:
    rules = baskets.association_rules(baskets.frequent_itemsets(_coarse_items(run)))
    return _rounded(rules, 6, *RULE_MEASURES)


@query
def rules_dedup_deep(run: Inputs) -> DataFrame:
    rules = baskets.association_rules(baskets.frequent_itemsets(_coarse_items(run)))
    kept = baskets.drop_mirrored(rules)
    return _rounded(kept.select("segment", "antecedents", "consequents", "lift"), 6, "lift")


@query
def frequent_pairs(run: Inputs) -> DataFrame:
    pairs = baskets.frequent_itemsets(run.items).filter(F.size("items") == 2)
    return pairs.select(
        "segment",
        F.element_at("items", 1).alias("item_a"),
        F.element_at("items", 2).alias("item_b"),
        "freq",
        (F.col("freq").cast("double") / F.col("baskets")).alias("support"),
    )


RULE_MEASURES = (
    "antecedent_support",
    "consequent_support",
    "support",
    "confidence",
    "lift",
    "leverage",
    "conviction",
    "zhang",
)


@query
def association_rules(run: Inputs) -> DataFrame:
    return _rounded(run.rules, 6, *RULE_MEASURES)


@query
def rules_dedup(run: Inputs) -> DataFrame:
    kept = baskets.drop_mirrored(run.rules)
    return _rounded(kept.select("segment", "antecedents", "consequents", "lift"), 6, "lift")


@query
def top_rules(run: Inputs) -> DataFrame:
    return baskets.top_rules(baskets.drop_mirrored(run.rules))


@query
def best_rules(run: Inputs) -> DataFrame:
    return bestrules.best_rules(baskets.frequent_itemsets(run.items))


@query
def best_rules_deep(run: Inputs) -> DataFrame:
    return bestrules.best_rules(baskets.frequent_itemsets(_coarse_items(run)))
