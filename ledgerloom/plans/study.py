"""The whole customer study as one set of tables.

``customer_study`` derives every table from the transactions; ``write_study``
saves them as CSV. The sales are scanned once for customer features, once for
the daily series and once for baskets; what those scans leave is small, is
written out, and feeds everything else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import (
    baskets,
    cleaning,
    customers,
    density,
    forecast,
    projection,
    quality,
    regression,
    segments,
    timeseries,
)
from ledgerloom.session import materialise
from ledgerloom.sources import tables
from ledgerloom.sources.schemas import TRANSACTION_DESCRIPTIONS


@dataclass(frozen=True)
class StudyOptions:
    """What an analyst may want to set; the defaults suit sums in single currency units."""

    ks: Sequence[int] = range(2, 9)
    rule_k: int = 3
    summary_ks: Sequence[int] = (3, 4)
    starts: int = 10
    frequency_limit: int = 50
    monetary_limit: float = 25000.0
    density_eps: float = 0.15
    support: float = 0.02
    horizon: int = 7
    validation: tuple[date, date] = (date(2011, 8, 15), date(2011, 8, 21))


def _segmentation(
    features: DataFrame, columns: list[str], method: str, options: StudyOptions
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Labels for every k, their scores, and the summaries of the best and the fixed ks."""
    points = segments.model_space(features, columns)
    axes = segments.scaled_names(columns)
    labelled = materialise(
        segments.segment_customers(points, axes, list(options.ks), options.starts).drop("point"), "labels"
    )
    labels = {k: f"cluster_{k}" for k in options.ks}
    scored = materialise(
        segments.score_labels(labelled, axes, labels, method), "scores"
    )
    best = segments.best_k(scored).first().Clusters
    wanted = {"best": best} | {str(k): k for k in options.summary_ks}
    summaries = {
        name: segments.cluster_summary(labelled, f"cluster_{k}", columns) for name, k in wanted.items()
    }
    return labelled, scored, summaries


def _forecasts(
    split: DataFrame, horizon: int, name: str, period: str | None = None
) -> dict[str, DataFrame]:
    train = split.filter(F.col("part") == "train").drop("part")
    test = split.filter(F.col("part") == "test").drop("part")
    compared = materialise(
        forecast.forecast_comparison(test, forecast.arima_forecast(train, horizon)), "forecast"
    )
    metrics = forecast.forecast_metrics(compared, "ARIMA(4,1,1)", f"{horizon} Days")
    if period:
        metrics = metrics.withColumn("ValidationPeriod", F.lit(period))
    return {f"{name}_comparison": compared, f"{name}_metrics": metrics}


def customer_study(
    transactions: DataFrame, options: StudyOptions = StudyOptions()
) -> dict[str, DataFrame]:
    """Every result table by name."""
    result: dict[str, DataFrame] = {
        "dataset_profile": quality.dataset_profile(
            transactions,
            ["InvoiceDate", "InvoiceNo", "StockCode", "Quantity", "UnitPrice"],
            TRANSACTION_DESCRIPTIONS,
        ),
        "rows_with_missing": quality.rows_with_missing(transactions),
        "missing_counts": quality.missing_counts(transactions),
    }
    clean = cleaning.clean_transactions(transactions)
    features = materialise(customers.customer_features(clean), "features")
    result["customer_features"] = features
    result["rfm_stats"] = quality.summary_statistics(features, customers.RFM)
    result["extended_stats"] = quality.summary_statistics(features, customers.EXTENDED)
    result["rfm_correlation"] = quality.correlation_matrix(features, customers.RFM)

    rfm_labels, result["kmeans_rfm"], summaries = _segmentation(
        features, customers.RFM, "KMeans_RFM", options
    )
    result |= {f"rfm_clusters_{name}": table for name, table in summaries.items()}
    _, result["kmeans_extended"], summaries = _segmentation(
        features, customers.EXTENDED, "KMeans_ExtendedFeatures", options
    )
    result |= {f"extended_clusters_{name}": table for name, table in summaries.items()}
    typical = segments.model_space(quality.without_outliers(features, "Monetary"), customers.RFM)
    axes = segments.scaled_names(customers.RFM)
    result["kmeans_without_outliers"] = segments.kmeans_sweep(
        typical, axes, "KMeans_Filtered", [2], options.starts
    )
    points = segments.model_space(features, customers.RFM)
    dense = materialise(
        density.density_clusters(points, axes, options.density_eps).drop("point"), "dense"
    )
    result["density_summary"] = segments.cluster_summary(dense, "cluster", customers.RFM)
    result["density_silhouette"] = density.density_silhouette(dense, axes)
    result["customer_map"] = projection.pca_projection(points, ["CustomerID", "Monetary"])

    model = regression.spend_regression(features)
    result["spend_model"] = regression.model_report(model, "Linear Regression", regression.BASELINE)
    result["actual_vs_predicted"] = regression.actual_vs_predicted(model)
    kept = customers.capped(features, options.frequency_limit, options.monetary_limit)
    result["spend_model_capped"] = regression.model_report(
        regression.spend_regression(kept), "Filtered Linear Regression", regression.BASELINE
    ).withColumns(
        {
            "FrequencyLimit": F.lit(options.frequency_limit),
            "MonetaryLimit": F.lit(options.monetary_limit),
        }
    )
    result["spend_model_comparison"] = regression.regression_comparison(features)

    daily = materialise(timeseries.daily_sales(clean), "daily")
    filled = timeseries.fill_days(daily)
    result["daily_sales"] = timeseries.rolling_sales(daily)
    result["monthly_sales"] = timeseries.monthly_totals(daily)
    result |= _forecasts(timeseries.holdout_split(filled, options.horizon), options.horizon, "forecast")
    start, end = options.validation
    result |= _forecasts(
        timeseries.window_split(filled, start, end),
        (end - start).days + 1,
        "validation",
        f"{start} to {end}",
    )

    labels = rfm_labels.select("CustomerID", F.col(f"cluster_{options.rule_k}").alias("segment"))
    itemsets = baskets.frequent_itemsets(baskets.basket_items(clean, labels), options.support)
    rules = materialise(baskets.drop_mirrored(baskets.association_rules(itemsets)), "rules")
    result["association_rules"] = rules
    result["top_rules"] = baskets.top_rules(rules)
    return result


def write_study(study: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header, in a folder of its own name."""
    for name, table in study.items():
        if name == "association_rules":
            tables.write_partitioned(table, f"{folder}/{name}", ["segment"], "csv")
        else:
            tables.write_csv(table, f"{folder}/{name}")
