"""Cluster quality scores, of several labellings in one pass each."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])


STRETCH = 1 << 18  # distances held at a time


def _rows(labelled: DataFrame, coordinates: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One array of coordinates and the labels of every point."""
    axes = F.array(*[F.col(name).cast("double") for name in coordinates])
    return labelled.select(axes.alias("x"), *[F.col(label).alias(f"l{i}") for i, label in enumerate(labels)])


def _places(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float)


def cluster_moments(
    labelled: DataFrame, coordinates: Sequence[str], labels: Sequence[str]
) -> list[tuple[pa.Array, np.ndarray]]:
    """For each labelling its clusters in order, and their (number, sums, sum of squares).

    One pass over the points. The driver gets a row for each cluster, so a label column must have few values.
    """
    dims, points = len(coordinates), _rows(labelled, coordinates, labels)
    kinds = [field.dataType for field in points.schema.fields[1:]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _places(batch, dims)
            columns = [np.ones(len(x)), *x.T, (x * x).sum(axis=1)]
            for i in range(len(kinds)):
                coded = batch.column(i + 1).drop_null().dictionary_encode()
                known = batch.column(i + 1).is_valid().to_numpy(zero_copy_only=False)
                size = len(coded.dictionary)
                sums = [np.bincount(coded.indices.to_numpy(), column[known], size) for column in columns]
                arrays = [pa.array([i] * size, pa.int32())]
                arrays += [coded.dictionary if j == i else pa.nulls(size, c.type) for j, c in enumerate(batch.columns[1:])]
                names = ["i", *batch.schema.names[1:], *[f"s{n}" for n in range(dims + 2)]]
                yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, sums)], names=names)

    names = [f"l{i}" for i in range(len(kinds))]
    fields = ["i int", *[f"{n} {kind.simpleString()}" for n, kind in zip(names, kinds)]]
    summed = (
        points.mapInArrow(add, ", ".join([*fields, *[f"s{n} double" for n in range(dims + 2)]]))
        .groupBy("i", *names)
        .agg(*[F.sum(f"s{n}").alias(f"s{n}") for n in range(dims + 2)])
        .orderBy("i", *names)
    )
    found = summed.collect()
    kept = to_arrow_schema(points.schema)
    moments = []
    for i, name in enumerate(names):
        mine = [row for row in found if row["i"] == i]
        values = pa.array([row[name] for row in mine], kept.field(name).type)
        moments.append((values, np.array([row[-dims - 2 :] for row in mine], float).reshape(-1, dims + 2)))
    return moments


def cluster_scores(labelled: DataFrame, coordinates: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(label_column, cluster, centre, rows, score, compared, spread) of every cluster of several labellings.

    ``score`` sums the silhouettes of the cluster's points, ``compared`` counts the points that
    have another cluster, ``spread`` is the mean distance to the centre. Points without
    a label form a row without cluster and score 0. Tasks add their points up by cluster.
    """
    dims, names = len(coordinates), list(labels)
    moments = cluster_moments(labelled, coordinates, labels)

    def scored(x: np.ndarray, own: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Silhouettes and distances to the own centre of labelled points."""
        n, centre = sums[:, 0], sums[:, 1:-1] / sums[:, :1]
        gap = (x * x).sum(axis=1)[:, None] * n - 2 * (x @ sums[:, 1:-1].T) + sums[:, -1]
        gap = np.maximum(gap, 0.0)  # rounding may leave a tiny negative
        every = np.arange(len(x))
        mine, size = gap[every, own].copy(), n[own]
        gap /= n
        gap[every, own] = np.inf
        a, b = mine / np.maximum(size - 1, 1), gap.min(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            apart = np.where((size > 1) & (np.maximum(a, b) > 0) & (b < np.inf), (b - a) / np.maximum(a, b), 0.0)
        return apart, np.sqrt(((x - centre[own]) ** 2).sum(axis=1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(values) + 1, 3)) for values, _ in moments]  # the last row is without label
        for batch in batches:
            x = _places(batch, dims)
            for i, (values, sums) in enumerate(moments):
                place = pc.index_in(batch.column(i + 1), values).fill_null(len(values)).to_numpy(zero_copy_only=False)
                totals[i][-1, 0] += (place == len(values)).sum()
                inside = np.flatnonzero(place < len(values))
                step = max(1, STRETCH // max(len(values), 1))
                for begin in range(0, len(inside), step):
                    some = inside[begin : begin + step]
                    score, spread = scored(x[some], place[some], sums)
                    for k, column in enumerate((np.ones(len(some)), score, spread)):
                        totals[i][:, k] += np.bincount(place[some], column, len(values) + 1)
        for i, (values, sums) in enumerate(moments):
            held = np.flatnonzero(totals[i][:, 0])
            size, last = len(held), len(values)
            centres = [(sums[j, 1:-1] / sums[j, 0]).tolist() if j < last else None for j in held]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i]] * size, pa.string()),
                    pa.array([int(j) if j < last else None for j in held], pa.int64()),
                    pa.array(centres, pa.list_(pa.float64())),
                    pa.array([bool(j < last and last > 1) for j in held], pa.bool_()),
                    *[pa.array(totals[i][held, k]) for k in range(3)],
                ],
                names=["label_column", "cluster", "centre", "others", "n", "score", "spread"],
            )

    schema = "label_column string, cluster bigint, centre array<double>, others boolean, n double, score double, spread double"
    return (
        _rows(labelled, coordinates, labels)
        .mapInArrow(add, schema)
        .groupBy("label_column", "cluster", "centre", "others")
        .agg(F.sum("n").alias("rows"), F.sum("score").alias("score"), F.sum("spread").alias("spread"))
        .select(
            "label_column",
            "cluster",
            "centre",
            "rows",
            "score",
            F.when(F.col("others"), F.col("rows")).otherwise(0.0).alias("compared"),
            (F.col("spread") / F.col("rows")).alias("spread"),
        )
    )


def _mean_silhouette() -> Column:
    # With a single cluster there is no score.
    return F.when(F.sum("compared") > 0, F.sum("score") / F.sum("rows")).alias("silhouette")


def silhouettes(labelled: DataFrame, coordinates: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Mean silhouette of several labellings over all points: (label_column, silhouette).

    Distances are squared Euclidean, so a cluster's count, sum and sum of squares
    give the summed distances of a point to all its members in closed form. One
    pass sums the clusters and one scores the points. The sums hold one row per
    cluster, so a label column must have few values.
    """
    return cluster_scores(labelled, coordinates, labels).groupBy("label_column").agg(_mean_silhouette())


def euclidean_silhouettes(
    labelled: DataFrame,
    coordinates: Sequence[str],
    labels: Sequence[str],
    key: str = "CustomerID",
    draws: int = 1000,
) -> DataFrame:
    """Silhouettes by plain Euclidean distance: (label_column, draws, silhouette, standard_error).

    Such distances have no closed form, so the score is a mean over at most
    ``draws`` points, those of the smallest key digests, each against all points.
    Tasks add up distances by drawn point and cluster in matrices, so what leaves
    them is draws times clusters, whatever the number of points. The error is that
    of a draw without replacement: where the draw covers all points, the score is
    exact and the error zero. A point alone in its cluster scores 0.
    """
    axes = [F.col(name).cast("double") for name in coordinates]
    points = labelled.select(F.array(*axes).alias("x"), F.array(*[F.col(c).cast("bigint") for c in labels]).alias("c"))
    digest = F.md5(F.col(key).cast("string"))
    chosen = labelled.select(digest.alias("d"), F.array(*axes).alias("x"), F.array(*[F.col(c).cast("bigint") for c in labels]).alias("c"))
    drawn = chosen.orderBy("d").limit(draws).collect()  # set by the parameter
    spots = np.array([row["x"] for row in drawn], float).reshape(len(drawn), len(coordinates))
    own = np.array([row["c"] for row in drawn], np.int64).reshape(len(drawn), len(labels))
    names, dims = list(labels), len(coordinates)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            place = batch.column(0).flatten().to_numpy().reshape(-1, dims)
            cluster = batch.column(1).flatten().to_numpy().reshape(-1, len(names))
            for begin in range(0, len(place), 1024):
                part = place[begin : begin + 1024]
                gap = np.sqrt(sum((spots[:, None, i] - part[None, :, i]) ** 2 for i in range(dims)))
                for j in range(len(names)):
                    mine = cluster[begin : begin + 1024, j]
                    for value in np.unique(mine):
                        state = totals.setdefault((j, int(value)), [0, np.zeros(len(spots))])
                        state[0] += int((mine == value).sum())
                        state[1] += gap[:, mine == value].sum(axis=1)
        size = len(spots)
        for (j, value), (n, total) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[j]] * size), pa.array(range(size), pa.int64()), pa.array(own[:, j] == value),
                    pa.array([value] * size, pa.int64()), pa.array([n] * size, pa.int64()), pa.array(total),
                ],
                names=["label_column", "draw", "own", "cluster", "n", "total"],
            )

    schema = "label_column string, draw bigint, own boolean, cluster bigint, n bigint, total double"
    sums = (
        points.mapInArrow(add, schema)
        .groupBy("label_column", "draw", "own", "cluster")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .groupBy("label_column", "draw")
        .agg(
            F.sum("n").alias("all"),
            F.max(F.when(F.col("own"), F.col("n"))).alias("size"),
            F.max(F.when(F.col("own"), F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
            F.min(F.when(~F.col("own"), F.col("total") / F.col("n"))).alias("b"),
        )
    )
    apart = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    score = F.when(F.col("size") == 1, F.lit(0.0)).otherwise(apart)
    unseen = F.sqrt(F.lit(1.0) - F.count(F.lit(1)) / F.max("all"))
    error = F.coalesce(F.stddev_samp(score), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)).cast("double")) * unseen
    return sums.groupBy("label_column").agg(
        F.count(F.lit(1)).alias("draws"),
        F.when(F.count("b") > 0, F.avg(score)).alias("silhouette"),  # none of a single cluster
        F.when(F.count("b") > 0, error).alias("standard_error"),
    )


def _distance(left: Column, right: Column) -> Column:
    """Euclidean distance of two equally long arrays."""
    squares = F.zip_with(left, right, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def davies_bouldins(labelled: DataFrame, coordinates: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """The Davies-Bouldin index of several labellings: (label_column, davies_bouldin).

    Centres and spreads are one row per cluster; their comparison happens inside
    one array of that many entries per labelling.
    """
    return both_scores(labelled, coordinates, labels).filter("davies_bouldin IS NOT NULL").drop("silhouette")


def both_scores(labelled: DataFrame, coordinates: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(label_column, silhouette, davies_bouldin) of several labellings, from two passes over the points."""
    clusters = (
        cluster_scores(labelled, coordinates, labels)
        .groupBy("label_column")
        .agg(
            _mean_silhouette(),
            F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", "centre", "spread"))).alias("all"),
        )
    )

    def worst(this: Column) -> Column:
        others = F.filter("all", lambda other: other["cluster"] != this["cluster"])
        ratios = F.transform(
            others,
            lambda other: F.try_divide(
                this["spread"] + other["spread"], _distance(this["centre"], other["centre"])
            ),
        )
        return F.coalesce(F.array_max(ratios), F.lit(0.0))

    total = F.aggregate(F.transform("all", worst), F.lit(0.0), lambda total, x: total + x)
    index = F.try_divide(total, F.size("all")).alias("davies_bouldin")
    return clusters.select("label_column", "silhouette", index)


def davies_bouldin(labelled: DataFrame, coordinates: Sequence[str], label: str) -> DataFrame:
    """One row: the Davies-Bouldin index of a labelling."""
    return davies_bouldins(labelled, coordinates, [label]).select("davies_bouldin")
