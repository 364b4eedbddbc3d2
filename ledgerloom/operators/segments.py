"""Customer segmentation by k-means and the summaries of any segmentation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import half_even
from ledgerloom.functions.columns import FEATURE
from ledgerloom.operators import kmeans
from ledgerloom.operators.customers import log_features
from ledgerloom.operators.scaling import assemble, standardise
from ledgerloom.operators.scores import both_scores
from ledgerloom.session import materialise


def model_space(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p, then standardise, then a ``point`` vector, beside the input columns.

    Written out once: fits and scores read it dozens of times.
    """
    logs = [f"{name}_log" for name in columns]
    scaled = standardise(log_features(features, list(columns)), logs)
    return assemble(materialise(scaled, "model-space"), scaled_names(columns))


def scaled_names(columns: Sequence[str]) -> list[str]:
    return [f"{name}_log_scaled" for name in columns]


def with_labels(points: DataFrame, coordinates: Sequence[str], ks: Sequence[int], starts: int = 10) -> DataFrame:
    """Points with ``cluster_<k>`` for each k, from models that are fitted together."""
    return kmeans.labelled(points, coordinates, kmeans.fit_models(points, coordinates, list(ks), starts))


def relabel(labelled: DataFrame, label: str, by: str = "Monetary") -> DataFrame:
    """Number clusters 0..k-1 by falling mean of a column, so ids do not depend on the seed."""
    means = labelled.groupBy(label).agg(F.avg(by).alias("_mean"))  # k rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_mean"), label)
    ids = means.select(F.col(label), (F.row_number().over(order) - 1).alias("_id"))
    return (
        labelled.join(F.broadcast(ids), label)
        .withColumn(label, F.col("_id"))
        .drop("_id")
    )


def kmeans_sweep(
    points: DataFrame,
    coordinates: Sequence[str],
    method: str,
    ks: Sequence[int] = range(2, 9),
    starts: int = 10,
) -> DataFrame:
    """Silhouette and Davies-Bouldin score of the best k-means model for each k."""
    labels = [f"cluster_{k}" for k in ks]
    labelled = materialise(with_labels(points, coordinates, ks, starts).select(*coordinates, *labels), "labelled")
    return score_labels(labelled, coordinates, {k: f"cluster_{k}" for k in ks}, method)


def score_labels(
    labelled: DataFrame,
    coordinates: Sequence[str],
    labels: dict[int, str],
    method: str,
) -> DataFrame:
    """One row per labelling: (Method, Clusters, SilhouetteScore, DaviesBouldinIndex)."""
    scores = both_scores(labelled, coordinates, list(labels.values()))
    clusters = reduce(
        lambda rest, item: F.when(F.col("label_column") == item[1], item[0]).otherwise(rest),
        labels.items(),
        F.lit(None).cast("int"),
    )
    return scores.filter("davies_bouldin IS NOT NULL").select(
        F.lit(method).alias("Method"),
        clusters.alias("Clusters"),
        half_even(F.col("silhouette"), 4).alias("SilhouetteScore"),
        half_even(F.col("davies_bouldin"), 4).alias("DaviesBouldinIndex"),
    )


def best_k(scores: DataFrame) -> DataFrame:
    """One row: the k of the highest rounded silhouette, the smallest k on a tie."""
    return scores.orderBy(F.desc("SilhouetteScore"), "Clusters").limit(1)


def segment_customers(
    points: DataFrame, coordinates: Sequence[str], ks: Sequence[int] = (3, 4), starts: int = 10
) -> DataFrame:
    """Each customer with its label under every k, as ``cluster_k`` columns."""
    labelled = materialise(with_labels(points, coordinates, ks, starts), "labelled")
    return reduce(lambda frame, k: relabel(frame, f"cluster_{k}"), ks, labelled)


def winning_segments(
    points: DataFrame, coordinates: Sequence[str], ks: Sequence[int] = range(2, 9), starts: int = 10
) -> DataFrame:
    """Each customer with ``cluster``, its label under the k of the highest silhouette, and ``Clusters``, that k."""
    labelled = materialise(with_labels(points, coordinates, ks, starts), "labelled")
    scores = score_labels(labelled, coordinates, {k: f"cluster_{k}" for k in ks}, "KMeans")
    row = best_k(scores).first()
    if row is None:
        return labelled.withColumns({"cluster": F.lit(0), "Clusters": F.lit(0)})  # no customers
    k = row["Clusters"]
    return relabel(labelled, f"cluster_{k}").withColumns({"cluster": F.col(f"cluster_{k}"), "Clusters": F.lit(k)})


def cluster_summary(labelled: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each feature, customer count and share of all rows, per cluster.

    Sums are exact decimals, and the share comes from the k counted rows.
    """
    counted = labelled.groupBy(label).agg(
        *[F.sum(F.col(name).cast(FEATURE)).cast("double").alias(name) for name in columns],
        F.count(F.lit(1)).alias("CustomerCount"),
    )
    everyone = F.sum("CustomerCount").over(Window.partitionBy(F.lit(0)))
    return counted.select(
        label,
        *[half_even(F.col(name) / F.col("CustomerCount"), 2).alias(name) for name in columns],
        "CustomerCount",
        half_even(F.col("CustomerCount") / everyone * 100, 2).alias("Percentage"),
    )
