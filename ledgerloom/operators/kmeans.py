"""Many k-means models fitted together.

Points lie on a grid of millionths of a standard deviation, so sums of points are
whole numbers: centres do not depend on the order of rows, on partitions or on
lost tasks. A model has converged when its centres, all together, move by a squared
distance of at most ``TOLERANCE`` of a standardised axis's variance. One pass over
the points a round yields the sums of every model that still moves. The
driver holds the centres, a table whose size is set by the parameters, and the
seeds, as many points as the largest model has centres over all starts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1_000_000
TOLERANCE = 1e-4
STRETCH = 2048  # points compared with all centres at a time

Centres = list[tuple[float, ...]]


def grid(coordinates: Sequence[str]) -> list[Column]:
    """A point's place on the grid, one whole number for each coordinate."""
    return [F.round(F.col(name).cast("double") * F.lit(float(SCALE))).cast("bigint") for name in coordinates]


def seeds(points: DataFrame, coordinates: Sequence[str], key: str, count: int) -> list[tuple[int, ...]]:
    """Distinct points in the order of the smallest digest of their keys: a draw that any run repeats."""
    names = [f"q{i}" for i in range(len(coordinates))]
    placed = points.select(*[c.alias(n) for c, n in zip(grid(coordinates), names)], F.md5(F.col(key).cast("string")).alias("d"))
    drawn = placed.groupBy(*names).agg(F.min("d").alias("d")).orderBy("d").limit(count)
    return [tuple(row[name] for name in names) for row in drawn.collect()]  # set by the parameters


def nearest(values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres of every point."""
    total = np.zeros((len(values), len(centres)))
    for axis in range(values.shape[1]):
        step = values[:, axis, None] - centres[None, :, axis]
        total += step * step
    return total.argmin(axis=1)


class Stretch:
    """Sums of stretches of points over the clusters of many models.

    All distances come from one matrix product, up to a bound on its rounding error. A
    point with two centres of a model within that bound goes to ``nearest``, so the
    outcome is always that of ``nearest``; sums of so few whole numbers are exact.
    The matrices are kept from stretch to stretch.
    """

    def __init__(self, models: list[np.ndarray]) -> None:
        self.models, centres = models, np.vstack(models)
        ends = np.cumsum([len(model) for model in models])
        self.parts = [slice(end - len(model), end) for end, model in zip(ends, models)]
        squares = (centres * centres).sum(axis=1, keepdims=True)
        self.form, self.reach = np.hstack([-2 * centres, squares]), np.sqrt(squares.max())
        self.each = np.ones(len(centres))
        self.gap, self.mine = (np.empty((len(centres), STRETCH)) for _ in range(2))
        self.held, self.bound = np.empty((len(centres), STRETCH), bool), np.empty(STRETCH)

    def sums(self, points: np.ndarray) -> np.ndarray:
        """For each centre of each model in turn, the sums and the number of its points."""
        size, width = points.shape
        ones = np.hstack([points, np.ones((size, 1))])
        gap, mine, held, bound = self.gap[:, :size], self.mine[:, :size], self.held[:, :size], self.bound[:size]
        np.matmul(self.form, ones.T, out=gap)
        far = np.sqrt((points * points).sum(axis=1).max()) + self.reach
        slack = 64 * (width + 2) * np.finfo(float).eps * far * far
        for part in self.parts:
            np.min(gap[part], axis=0, out=bound)
            bound += slack
            np.less_equal(gap[part], bound, out=held[part])
        mine[:] = held
        unsure = np.flatnonzero(self.each @ mine != len(self.models))
        if len(unsure):
            for part, model in zip(self.parts, self.models):
                some = mine[part, unsure]
                which = np.flatnonzero(some.sum(axis=0) != 1)
                label = nearest(points[unsure[which]], model)
                some[:, which] = np.arange(len(model))[:, None] == label
                mine[part, unsure] = some
        return mine @ ones


def cluster_sums(space: DataFrame, models: dict[int, Centres]) -> dict[int, dict[int, tuple[int, tuple[int, ...]]]]:
    """(number, sum) of the points of every cluster of every model, from one pass."""
    arrays = {model: np.array(centres) for model, centres in models.items()}
    width = len(next(iter(models.values()))[0])
    schema = "model int, cluster int, n bigint, total array<bigint>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, sums = Stretch(list(arrays.values())), np.int64(0)
        for batch in batches:
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            for begin in range(0, len(points), STRETCH):
                sums = sums + stretch.sums(points[begin : begin + STRETCH]).astype(np.int64)
        if np.ndim(sums) == 0:  # no points
            return
        names = [(model, j) for model, centres in arrays.items() for j in range(len(centres))]
        rows = [(*name, int(total[-1]), total[:-1].tolist()) for name, total in zip(names, sums) if total[-1]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["model", "cluster", "n", "total"]
        )

    summed = (
        space.mapInArrow(add, schema)
        .groupBy("model", "cluster")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    )
    found: dict[int, dict] = {model: {} for model in models}
    for row in summed.collect():  # a row for each centre
        found[row["model"]][row["cluster"]] = (row["n"], tuple(row[f"s{i}"] for i in range(width)))
    return found


def fit_models(
    points: DataFrame,
    coordinates: Sequence[str],
    ks: Sequence[int],
    starts: int = 10,
    key: str = "CustomerID",
    rounds: int = 300,
) -> dict[int, Centres]:
    """For each k, the centres of the best of several starts, on the grid.

    Start s of k centres takes the seeds s, s + starts, s + 2 * starts and so on.
    The best start leaves the least squared distance, that is the largest sum of
    |S|^2 / n over its clusters, taken in whole numbers; the first of equals wins.
    Where fewer distinct points than seeds exist, they are taken in turn; a
    centre that no point is nearest to stays where it is. No points give no centres.
    """
    space = points.select(F.array(*grid(coordinates)).alias("x")).persist()
    try:
        drawn = seeds(points, coordinates, key, starts * max(ks))
        if not drawn:
            return {k: [] for k in ks}
        jobs = [(k, start) for k in ks for start in range(starts)]
        models: dict[int, Centres] = {
            i: [tuple(map(float, drawn[(start + starts * j) % len(drawn)])) for j in range(k)]
            for i, (k, start) in enumerate(jobs)
        }
        gains: dict[int, int] = {}
        moving = dict(models)
        for _ in range(rounds):
            sums = cluster_sums(space, moving)
            for model, centres in list(moving.items()):
                clusters = sums[model]
                gains[model] = sum(sum(s * s for s in total) // n for n, total in clusters.values())
                moved = [
                    tuple(s / clusters[j][0] for s in clusters[j][1]) if j in clusters else centre
                    for j, centre in enumerate(centres)
                ]
                models[model] = moved
                shift = sum((a - b) * (a - b) for new, old in zip(moved, centres) for a, b in zip(new, old))
                if shift <= TOLERANCE * SCALE * SCALE:
                    del moving[model]
                else:
                    moving[model] = moved
            if not moving:
                break
    finally:
        space.unpersist()
    best = {k: max((i for i, job in enumerate(jobs) if job[0] == k), key=lambda i: (gains[i], -i)) for k in ks}
    return {k: models[i] for k, i in best.items()}


def labelled(points: DataFrame, coordinates: Sequence[str], models: dict[int, Centres]) -> DataFrame:
    """Add ``cluster_<k>``: the number of the first nearest centre, in expressions of a size set by k."""
    places = grid(coordinates)

    def label(centres: Centres) -> Column:
        if not centres:
            return F.lit(None).cast("int")
        ways = []
        for j, centre in enumerate(centres):
            steps = [place.cast("double") - F.lit(c) for place, c in zip(places, centre)]
            total = steps[0] * steps[0]
            for step in steps[1:]:
                total = total + step * step
            ways.append(F.struct(total.alias("d"), F.lit(j).alias("j")))
        return F.array_min(F.array(*ways))["j"]

    return points.withColumns({f"cluster_{k}": label(centres) for k, centres in models.items()})
