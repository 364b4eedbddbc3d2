"""Near-duplicate vectors by an exact metric range join.

Cosine at or above a threshold is a Euclidean distance of at most r between unit
vectors. Pivots drawn from the vectors cut them into cells by the nearest pivot.
A vector can only have partners in another cell if it lies within r of the plane
between the two pivots and, by the triangle inequality, within r of the cell's
radius around its pivot; it visits the later one of such cells. Every cell joins
its own vectors with one another and with its visitors, independently of all
other cells. No linked pair is missed.

Cells and visitors are split into blocks of bounded size, a pair of blocks being
one task, so a cell with a third of all vectors is many tasks. A block counts
links and merges its linked vectors into trees, so a group of n copies gives n
rows and not n * n. Vectors spread evenly over many dimensions have no cells to
speak of and visit most of them; the join then costs what comparing all does.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, link with nothing and are their own
component; rows repeating id and vector count as one vector and get one result
each; different vectors under one id are vectors of their own, which may link with
one another; vectors link with those of their length only, each length being joined
by itself; an empty table gives no rows. Columns besides the id and the vector are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import components
from ledgerloom.llm.vectors import matrix, numbered_vectors, spaces
from ledgerloom.session import materialise

CELL = 8192  # vectors per cell aimed at
MOST_PIVOTS = 4096
OWN_BLOCK, VISITOR_BLOCK = 16_384, 65_536
STRIP = 256
LINKS = "vec_id bigint, links bigint, root bigint"


def draw_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """``count`` unit vectors drawn by id; their number is bounded."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).toPandas()
    points = np.stack(rows["vector"].to_list()).astype(float)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * points @ pivots.T, 0))


def home_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, vector, home, away): the nearest pivot and its distance."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1))
            if not len(points):
                continue
            points /= np.linalg.norm(points, axis=1, keepdims=True)
            distance = _distances(points, pivots)
            home = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(home), pa.array(distance.min(axis=1))],
                names=["vec_id", "vector", "home", "away"],
            )

    return vectors.mapInArrow(assign, "vec_id bigint, vector array<double>, home bigint, away double")


def visits(homes: DataFrame, pivots: np.ndarray, radii: np.ndarray, reach: float) -> DataFrame:
    """(cell, vec_id, vector) for each later cell in which a vector may have a partner."""
    between = _distances(pivots, pivots)
    slack = reach + 1e-9

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1))
            if not len(points):
                continue
            points /= np.linalg.norm(points, axis=1, keepdims=True)
            home = batch.column(2).to_numpy()
            distance = _distances(points, pivots)
            own = distance[np.arange(len(home)), home][:, None]
            plane = (distance**2 - own**2) / np.maximum(2 * between[home], 1e-12)
            near = (plane <= slack) & (distance <= radii[None, :] + slack)
            near &= np.arange(len(pivots))[None, :] > home[:, None]
            row, cell = np.nonzero(near)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), batch.column(0).take(at), batch.column(1).take(at)],
                names=["cell", "vec_id", "vector"],
            )

    return homes.select("vec_id", "vector", "home").mapInArrow(
        visit, "cell bigint, vec_id bigint, vector array<double>"
    )


def block_links(
    own_ids: np.ndarray, own: np.ndarray, ids: np.ndarray, other: np.ndarray, threshold: float, inner: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vec_id, links, root) of vectors with links between two blocks, or inside one of them.

    The root is the smallest id a vector is connected to within the blocks.
    """
    every = np.concatenate([own_ids, ids])
    rank = np.argsort(np.argsort(every, kind="stable"), kind="stable")
    left, right = rank[: len(own_ids)], rank[len(own_ids) :]
    if inner:
        right = left
    parent = np.arange(len(every))
    links = np.zeros(len(every), np.int64)
    own_size, size = np.linalg.norm(own, axis=1), np.linalg.norm(other, axis=1)

    def roots(at: np.ndarray) -> np.ndarray:
        at = parent[at]
        while (parent[at] != at).any():
            at = parent[at]
        return at

    for begin in range(0, len(own), STRIP):
        rows = slice(begin, begin + STRIP)
        near = own[rows] @ other.T >= threshold * own_size[rows, None] * size[None, :]
        if inner:
            near[np.arange(len(near)), np.arange(begin, begin + len(near))] = False
        counts = near.sum(axis=1)
        links[left[rows]] += counts
        if not inner:
            links[right] += near.sum(axis=0)
        for row in np.flatnonzero(counts):
            partners = np.append(right[near[row]], left[begin + row])
            found = np.unique(roots(partners))
            parent[found] = found[0]
            parent[partners] = found[0]
    order = np.sort(every)
    at = np.flatnonzero(links)
    return order[at], links[at], order[roots(at)] if len(at) else order[at]


def space_links(vectors: DataFrame, total: int, threshold: float) -> DataFrame:
    """(vec_id, links, root) of the linked vectors among ``total`` ones of one length."""
    pivots = draw_pivots(vectors, min(MOST_PIVOTS, -(-total // CELL)))
    homes = materialise(home_cells(vectors, pivots), "homes")
    sizes, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in homes.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        sizes[row["home"]], radii[row["home"]] = row["n"], row["r"]  # one row per pivot
    guests = materialise(visits(homes, pivots, radii, float(np.sqrt(2 - 2 * threshold))), "guests")
    coming = {row["cell"]: row["count"] for row in guests.groupBy("cell").count().collect()}
    own_blocks = [max(1, -(-int(n) // OWN_BLOCK)) for n in sizes]
    guest_blocks = [-(-coming.get(cell, 0) // VISITOR_BLOCK) for cell in range(len(pivots))]
    home_count = F.array(*[F.lit(n) for n in own_blocks])
    guest_count = F.array(*[F.lit(n) for n in guest_blocks])
    number = F.xxhash64("vec_id")
    owners = homes.withColumn("block", F.pmod(number, home_count[F.col("home").cast("int")]).cast("int"))
    # A vector meets the blocks of its own cell from its own on, and the cell's visitors.
    meets = F.concat(
        F.transform(
            F.sequence(F.lit(0), home_count[F.col("home").cast("int")] - 1),
            lambda b: F.struct(
                F.least(b, F.col("block")).alias("own"), F.greatest(b, F.col("block")).alias("other"),
                F.lit("home").alias("kind"), (F.col("block") <= b).alias("first"),
            ),
        ),
        F.transform(
            F.when(
                guest_count[F.col("home").cast("int")] > 0,
                F.sequence(F.lit(0), guest_count[F.col("home").cast("int")] - 1),
            ).otherwise(F.array().cast("array<int>")),
            lambda b: F.struct(
                F.col("block").alias("own"), b.alias("other"), F.lit("guest").alias("kind"), F.lit(True).alias("first")
            ),
        ),
    )
    residents = owners.select("vec_id", "vector", F.col("home").alias("cell"), F.explode(meets).alias("m")).select(
        "vec_id", "vector", "cell", "m.*"
    )
    cell = F.col("cell").cast("int")
    visitors = guests.select(
        "vec_id", "vector", "cell",
        F.explode(F.sequence(F.lit(0), home_count[cell] - 1)).alias("own"),
        F.pmod(number, F.greatest(guest_count[cell], F.lit(1))).cast("int").alias("other"),
        F.lit("guest").alias("kind"),
        F.lit(False).alias("first"),
    )

    def link(group: pa.Table) -> pa.Table:
        ids, points = group.column("vec_id").to_numpy(), matrix(group.column("vector"))
        first = group.column("first").to_numpy(zero_copy_only=False).astype(bool)
        inner = first.all() and group.column("kind")[0].as_py() == "home"
        if inner:
            found = block_links(ids, points, ids[:0], points, threshold, True)
        elif first.all() or not first.any():
            found = (ids[:0], ids[:0], ids[:0])
        else:
            found = block_links(ids[first], points[first], ids[~first], points[~first], threshold, False)
        return pa.table([pa.array(x) for x in found], names=["vec_id", "links", "root"])

    return materialise(
        residents.unionByName(visitors)
        .groupBy("cell", "own", "other", "kind")
        .applyInArrow(link, LINKS),
        "links",
    )


def near_vectors(table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of a table of embeddings."""
    vectors, repeats = numbered_vectors(table)
    linked = table.sparkSession.createDataFrame([], LINKS)
    for size, total in spaces(vectors):
        if total > 1:
            own = vectors.filter(F.col("n") == size).select(F.col("node").alias("vec_id"), "vector")
            linked = linked.unionByName(space_links(own, total, threshold))
    counted = linked.groupBy(F.col("vec_id").alias("node")).agg(F.sum("links").alias("n_links"))
    named = components(linked.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    if repeats:
        # A component's name is its least id, which its least number need not be.
        members = materialise(named.join(vectors.select("node", "vec_id"), "node"), "members")
        least = members.groupBy("component").agg(F.min("vec_id").alias("least"))
        named = members.join(least, "component").select("node", F.col("least").alias("component"))
        rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).join(
            vectors.select("vec_id", "vector", "node"), ["vec_id", "vector"], "left"
        )
    else:
        rows = table.select("vec_id", F.col("vec_id").cast("bigint").alias("node"))
    component = F.coalesce("component", "vec_id")
    return rows.join(counted, "node", "left").join(named, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def oracle(threshold: float = 0.9) -> str:
    """All pairs of vectors, as SQL for the checking engine."""
    return f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.v, y.v) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(any_value(n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id GROUP BY e.vec_id
"""
