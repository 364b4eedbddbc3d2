"""Approximate nearest neighbours by inner product: an adaptive dimension scan of inverted lists.

Vectors get one more component that makes all of them equally long, so that the
nearest by distance are those of largest inner product; then a random rotation
spreads what they hold evenly over the dimensions. Lists are formed around
centroids fitted on a bounded sample, and every vector is in one list. A query
probes its nearest lists; how many follows from a bounded sample of queries, for
which the lists of the true neighbours are known.

Within a probed list dimensions are read in blocks of columns. After each block
a hypothesis test compares the distance so far, scaled to all dimensions, with
the distance of the query's worst result yet, and abandons candidates that are
very unlikely to get below it (Gao and Long, 2023). What is left is scored
exactly on the original vectors.

Lists, and the queries of a list, are split into blocks of bounded size, each
pair of blocks being one task; only the best few of each leave it.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; a query searches the vectors of
its length, each length having an index of its own; rows repeating id and vector
count as one, and different vectors under one id are candidates and queries of
their own; equal scores rank the smaller id first; a query finds all candidates
where there are fewer than wanted; no queries or no vectors give no rows. Columns
besides the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.vectors import matrix, numbered_vectors, spaces
from ledgerloom.session import materialise

SAMPLE = 16_384  # vectors from which the centroids are fitted
MOST_LISTS = 2048
TRIALS = 64  # queries from which the number of probes is set
WANTED_SHARE = 0.97
LIST_BLOCK, QUERY_BLOCK = 8192, 2048
COLUMNS = 16
CONFIDENCE = 2.1
DENSE = 0.05  # share of pairs below which they are followed one by one
SCHEMA = "query_id bigint, vec_id bigint, score double"


@dataclass
class Index:
    """The lifting radius, the rotation and the centroids in rotated space."""

    radius: float
    rotation: np.ndarray
    centroids: np.ndarray

    def rotated(self, points: np.ndarray, query: bool) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius**2 - (points**2).sum(axis=1), 0)) * (not query)
        return np.column_stack([points, rest]) @ self.rotation

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, up to a constant per point."""
        return (self.centroids**2).sum(axis=1)[None, :] - 2 * points @ self.centroids.T


def fit_index(vectors: DataFrame, seed: int = 7) -> tuple[Index, int]:
    """The index structure and the number of vectors; the driver holds the bounded sample."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    total, radius = vectors.agg(F.count("*"), F.max(norm)).first()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    points = np.stack(sample["vector"].to_list()).astype(float)
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.normal(size=(points.shape[1] + 1,) * 2))
    index = Index(float(radius), rotation, np.zeros((0, len(rotation))))
    lifted = index.rotated(points, query=False)
    lists = int(min(MOST_LISTS, max(1, round(np.sqrt(total) / 2)), len(lifted)))
    index.centroids = lifted[rng.permutation(len(lifted))[:lists]].copy()
    for _ in range(8):
        owner = index.distances(lifted).argmin(axis=1)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, owner, lifted)
        counts = np.bincount(owner, minlength=lists)
        index.centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], index.centroids)
    return index, total


def listed(vectors: DataFrame, index: Index) -> DataFrame:
    """(vec_id, vector, list) of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1))
            if len(points):
                owner = index.distances(index.rotated(points, query=False)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(owner, pa.int32())],
                    names=["vec_id", "vector", "list"],
                )

    return vectors.mapInArrow(assign, "vec_id bigint, vector array<double>, list int")


def probes_needed(lists: DataFrame, queries: DataFrame, index: Index, wanted: int) -> int:
    """How many lists hold the wanted share of the true neighbours of a bounded sample of queries."""
    trial = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).toPandas()
    ids = trial["vec_id"].to_numpy()
    points = np.stack(trial["vector"].to_list()).astype(float)
    order = index.distances(index.rotated(points, query=True)).argsort(axis=1).argsort(axis=1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = matrix(batch.column(1))
            if not len(others):
                continue
            score = points @ others.T
            score[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            top = np.argsort(-score, axis=1)[:, :wanted]
            query = np.repeat(np.arange(len(points)), top.shape[1])
            place = batch.column(2).to_numpy()[top.ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(query), pa.array(score[query, top.ravel()]), pa.array(order[query, place])],
                names=["query", "score", "turn"],
            )

    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "turn")
    turns = (
        lists.mapInArrow(best, "query bigint, score double, turn bigint")
        .withColumn("n", F.row_number().over(nearest))
        .filter(F.col("n") <= wanted)
        .select("turn")
        .toPandas()["turn"]
        .to_numpy()
    )
    return int(np.quantile(turns, WANTED_SHARE)) + 1 if len(turns) else 1


def scan(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, index: Index, wanted: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score): the best of a block for each query, by the adaptive scan."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    flat, rotated = index.rotated(queries, query=True), index.rotated(points, query=False)
    size = flat.shape[1]
    best = np.full((len(queries), wanted), -np.inf)
    named = np.full((len(queries), wanted), np.iinfo(np.int64).max)
    begin = 0
    while begin < len(points):
        # A first small step sets the limits against which later candidates are tested.
        end = min(len(points), begin + (4 * wanted if begin == 0 else 1024))
        chunk = rotated[begin:end]
        worst = best[:, -1]
        # Squared distance is |q|^2 + R^2 - 2 q.x, so the worst result gives the limit.
        limit = (queries**2).sum(axis=1) + index.radius**2 - 2 * worst
        alive = query_ids[:, None] != ids[None, begin:end]
        partial = np.zeros(alive.shape)
        query = item = so_far = None
        for low in range(0, size, COLUMNS):
            high = min(size, low + COLUMNS)
            bound = 1.0 if high == size else (1 + CONFIDENCE / np.sqrt(high)) ** 2
            scale = (high / size) * bound * (1 + 1e-9)
            if query is None and alive.mean() > DENSE:
                # While most pairs are left, a block of columns is one matrix product.
                left, right = flat[:, low:high], chunk[:, low:high]
                partial += (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * left @ right.T
                alive &= partial <= (limit * scale + 1e-12)[:, None]
                continue
            if query is None:
                query, item = np.nonzero(alive)
                so_far = partial[query, item]
            so_far = so_far + ((flat[query, low:high] - chunk[item, low:high]) ** 2).sum(axis=1)
            stays = so_far <= limit[query] * scale + 1e-12
            query, item, so_far = query[stays], item[stays], so_far[stays]
        if query is None:
            query, item = np.nonzero(alive)
        score = np.einsum("ij,ij->i", queries[query], points[begin + item])
        rows, first, count = np.unique(query, return_index=True, return_counts=True)
        if len(rows):
            wide = np.full((len(rows), wanted + count.max()), -np.inf)
            names = np.full(wide.shape, np.iinfo(np.int64).max)
            wide[:, :wanted], names[:, :wanted] = best[rows], named[rows]
            column = wanted + np.arange(len(query)) - np.repeat(first, count)
            row = np.repeat(np.arange(len(rows)), count)
            wide[row, column], names[row, column] = score, ids[begin + item]
            top = np.lexsort((names, -wide), axis=-1)[:, :wanted]
            best[rows] = np.take_along_axis(wide, top, axis=1)
            named[rows] = np.take_along_axis(names, top, axis=1)
        begin = end
    query, place = np.nonzero(best > -np.inf)
    return query_ids[query], named[query, place], best[query, place]


def search(
    table: DataFrame, queries: Column, wanted: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row that ``queries`` selects by ``vec_id``."""
    vectors, repeats = numbered_vectors(table, key, vector)
    asked = vectors.filter(queries)
    found = table.sparkSession.createDataFrame([], SCHEMA)
    for size, _ in spaces(asked):  # a length without queries needs no index
        own = F.col("n") == size
        number = F.col("node").alias("vec_id")
        found = found.unionByName(
            search_space(
                vectors.filter(own).select(number, "vector"), asked.filter(own).select(number, "vector"), wanted
            )
        )
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= wanted)
    if repeats:
        found = materialise(found, "found")
        ids = vectors.select("node", F.col("vec_id").alias("id"))
        by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "candidate")
        found = (
            found.select(F.col("query_id").alias("query"), F.col("vec_id").alias("candidate"), "score")
            .join(ids.toDF("query", "query_id"), "query")
            .join(ids.toDF("candidate", "vec_id"), "candidate")
            .withColumn("rank", F.row_number().over(by_id))
        )
    return found.select("query_id", "rank", "vec_id", "score")


def search_space(vectors: DataFrame, asked: DataFrame, wanted: int) -> DataFrame:
    """(query_id, vec_id, score) for vectors of one length: the best of every pair of blocks."""
    index, _ = fit_index(vectors)
    lists = materialise(listed(vectors, index), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for row in lists.groupBy("list").count().collect():  # one row per list
        sizes[row["list"]] = row["count"]
    least = probes_needed(lists, asked, index, wanted)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1))
            if not len(points):
                continue
            order = index.distances(index.rotated(points, query=True)).argsort(axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            # Enough lists for the wanted share, and for as many candidates as are wanted.
            row, turn = np.nonzero((np.arange(order.shape[1])[None, :] < least) | (held <= wanted))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(order[row, turn], pa.int32())],
                names=["query_id", "vector", "list"],
            )

    probes = materialise(
        asked.mapInArrow(probe, "query_id bigint, vector array<double>, list int"), "probes"
    )
    coming = {row["list"]: row["count"] for row in probes.groupBy("list").count().collect()}
    list_blocks = F.array(*[F.lit(max(1, -(-int(n) // LIST_BLOCK))) for n in sizes])
    query_blocks = F.array(*[F.lit(max(1, -(-coming.get(i, 0) // QUERY_BLOCK))) for i in range(len(sizes))])
    of = F.col("list")

    def all_blocks(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count[of] - 1))

    left = probes.select(
        "query_id", "vector", "list", all_blocks(list_blocks).alias("block"),
        F.pmod(F.xxhash64("query_id"), query_blocks[of]).cast("int").alias("turn"),
    )
    right = lists.select(
        "vec_id", "vector", "list",
        F.pmod(F.xxhash64("vec_id"), list_blocks[of]).cast("int").alias("block"),
        all_blocks(query_blocks).alias("turn"),
    )

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if asked.num_rows and held.num_rows:
            found = scan(
                asked.column("query_id").to_numpy(), matrix(asked.column("vector")),
                held.column("vec_id").to_numpy(), matrix(held.column("vector")), index, wanted,
            )
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    keys = ["list", "block", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, SCHEMA)


def oracle(wanted: int = 20, every: int = 20) -> str:
    """The exact neighbours as SQL, against which recall is measured."""
    return f"""
WITH sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT q.vec_id AS query_id, row_number() OVER w AS rank, c.vec_id, list_inner_product(q.v, c.v) AS score
FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)
QUALIFY rank <= {wanted}
"""
