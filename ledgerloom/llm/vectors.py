"""Vectors that take part in searches, and their way into numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise


def usable_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector, n): the distinct usable rows and their lengths.

    Vectors that are null, empty or zero, or hold a null or non-finite component,
    are left out, and so are rows with a null id. Rows that repeat both id and
    vector are one; an id may have several vectors.
    """
    values = F.col("vector")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        table.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & (F.size(values) > 0) & F.coalesce(finite, F.lit(False)))
        .filter(F.exists(values, lambda x: x != 0))
        .distinct()
        .withColumn("n", F.size("vector"))
    )


def numbered_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, bool]:
    """((node, vec_id, vector, n), whether ids repeat): usable vectors under a number of their own.

    The number is the id, unless rows of that id differ: then each vector but the
    one of least hash is numbered above all ids, by hash from 2^61 numbers or less.
    """
    vectors = usable_vectors(table, key, vector)
    content = F.xxhash64(F.col(vector).cast("array<double>"))
    repeated = materialise(
        table.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("vec_id"), content.alias("content"))
        .groupBy("vec_id")
        .agg(F.min("content").alias("least"), F.max("content").alias("most"))
        .filter("least < most")
        .select("vec_id", "least"),
        "repeated",
    )
    if repeated.isEmpty():
        node, found = F.col("vec_id").cast("bigint"), vectors
    else:
        most = table.agg(F.max(key)).first()[0]
        room = min(1 << 61, (1 << 63) - 1 - most)
        if room < 1 << 32:
            raise ValueError("ids leave no room for numbers of vectors that share an id")
        further = F.col("least").isNotNull() & (F.xxhash64("vector") != F.col("least"))
        number = F.lit(most + 1) + F.pmod(F.xxhash64("vec_id", "vector"), F.lit(room))
        node = F.when(further, number).otherwise(F.col("vec_id")).cast("bigint")
        found = vectors.join(repeated, "vec_id", "left")
    numbered = found.select(node.alias("node"), F.col("vec_id").cast("bigint").alias("vec_id"), "vector", "n")
    return materialise(numbered, "vectors"), found is not vectors


def spaces(vectors: DataFrame) -> list[tuple[int, int]]:
    """(length, rows) of every length that occurs; vectors of different lengths never meet.

    Lengths are as many as a caller's models, not as the rows.
    """
    return [(row["n"], row["count"]) for row in vectors.groupBy("n").count().orderBy("n").collect()]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column with lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)
