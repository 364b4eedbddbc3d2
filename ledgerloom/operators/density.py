"""Density clusters with noise, on a grid.

Space is cut into cells of side ``eps``. Points are only ever counted per cell;
neighbourhoods, growth and labels are joins between cells. A cell that holds a
third of all points is one counted row, and no two points are ever paired.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.scores import silhouettes
from ledgerloom.session import materialise, shared_folder

NOISE = -1


def cell_id(coordinates: Sequence[str], eps: float) -> Column:
    """The cell of a point: its whole steps along each axis, the last axis first."""
    return F.struct(
        *[
            F.floor(F.col(name) / F.lit(float(eps))).cast("bigint").alias(f"g{axis}")
            for axis, name in reversed(list(enumerate(coordinates)))
        ]
    )


def _block(cells: DataFrame, dimensions: int) -> DataFrame:
    """Each cell beside those of its 3^d block, itself included."""
    names = [f"g{axis}" for axis in reversed(range(dimensions))]
    moves = F.array(
        *[
            F.struct(*[F.lit(move).cast("bigint").alias(name) for name, move in zip(names, step)])
            for step in product((-1, 0, 1), repeat=dimensions)
        ]
    )

    def moved(step: Column) -> Column:
        return F.struct(*[(F.col("cell")[name] + step[name]).alias(name) for name in names])

    return cells.withColumn("near", F.explode(F.transform(moves, moved)))


def core_cells(
    points: DataFrame, coordinates: Sequence[str], eps: float, min_points: int = 5
) -> DataFrame:
    """Occupied cells with their own count, block count and whether they are core.

    A cell is core when its block holds at least ``min_points`` points.
    """
    cells = points.groupBy(cell_id(coordinates, eps).alias("cell")).agg(
        F.count(F.lit(1)).alias("points")
    )
    # Send each count to the whole block, then add up what arrives.
    received = (
        _block(cells, len(coordinates))
        .groupBy(F.col("near").alias("cell"))
        .agg(
            F.sum("points").alias("block_points"),
            F.max(F.when(F.col("near") == F.col("cell"), F.col("points"))).alias("points"),
        )
    )
    return received.filter(F.col("points").isNotNull()).select(
        "cell", "points", "block_points", (F.col("block_points") >= min_points).alias("core")
    )


def _components(core: DataFrame, dimensions: int) -> DataFrame:
    """The smallest cell id of each cell's connected component: (cell, root).

    Every round takes the smallest root among neighbours and then the root of
    that root, so paths shrink quickly. A checkpoint per round cuts the lineage.
    """
    shared_folder(core.sparkSession)
    ids = core.select("cell")
    edges = materialise(
        _block(ids, dimensions).join(ids.select(F.col("cell").alias("near")), "near"), "edges"
    )
    roots = ids.withColumn("root", F.col("cell"))
    while True:
        lowest = (
            edges.join(roots.select(F.col("cell").alias("near"), "root"), "near")
            .groupBy("cell")
            .agg(F.min("root").alias("lowest"))
        )
        hop = lowest.select(F.col("cell").alias("lowest"), F.col("lowest").alias("beyond"))
        moved = (
            roots.join(lowest, "cell")
            .join(hop, "lowest")
            .select("cell", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved"))
            .checkpoint()
        )
        roots = moved.select("cell", "root")
        if moved.filter("moved").isEmpty():
            return roots


def density_clusters(
    points: DataFrame,
    coordinates: Sequence[str],
    eps: float,
    min_points: int = 5,
    min_share: float = 0.03,
    label: str = "cluster",
) -> DataFrame:
    """Label points 0, 1, ... by falling cluster size, and -1 for noise.

    Core cells that touch form a cluster; a cell beside a core cell joins the
    touching cluster of lowest root. Clusters below ``min_share`` of all points
    become noise, so at most 1 / min_share clusters remain.
    """
    dimensions = len(coordinates)
    cells = materialise(core_cells(points, coordinates, eps, min_points), "cells")
    roots = _components(cells.filter("core"), dimensions)
    border = (
        _block(cells.filter(~F.col("core")).select("cell"), dimensions)
        .join(roots.select(F.col("cell").alias("near"), "root"), "near")
        .groupBy("cell")
        .agg(F.min("root").alias("root"))
    )
    members = roots.unionByName(border).join(cells.select("cell", "points"), "cell")
    everything = cells.agg(F.sum("points").cast("double")).scalar()
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "root")
    kept = (
        members.groupBy("root")
        .agg(F.sum("points").alias("size"))
        .filter(F.col("size") >= F.lit(min_share) * everything)
        .withColumn(label, (F.row_number().over(order) - 1).cast("int"))
    )
    # At most 1 / min_share rows.
    labels = members.join(F.broadcast(kept.select("root", label)), "root").select("cell", label)
    return (
        points.withColumn("cell", cell_id(coordinates, eps))
        .join(labels, "cell", "left")
        .withColumn(label, F.coalesce(F.col(label), F.lit(NOISE)))
        .drop("cell")
    )


def density_silhouette(
    labelled: DataFrame, coordinates: Sequence[str], label: str = "cluster"
) -> DataFrame:
    """One row: the silhouette without noise, null unless two clusters exist."""
    kept = labelled.filter(F.col(label) != NOISE)
    score = silhouettes(kept, coordinates, [label])
    return score.agg(F.max("silhouette").alias("silhouette"))
