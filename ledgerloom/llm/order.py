"""Numbering the rows of groups of any size, and digests of sorted groups of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialise

CHUNK = 1 << 15  # ids whose text travels as one row


def numbered(frame: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the place from 1 of every row in its group, written out.

    Rows are dealt out by ranges of group and order, so a large group lies in
    several tasks, each of which counts its own part. Only the group that a task
    begins with may have begun earlier; what earlier tasks hold of such groups is
    a table of at most two rows a task. Null is a group of its own.
    """
    columns = frame.columns
    by = [F.col(column) for column in group]
    dealt = (
        frame.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_key", F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0null")) for c in by]))
    )
    schema = dealt.select(*columns, "_part")
    fields = [*schema.schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, first = None, 0, True
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = batch.column(batch.num_columns - 1).to_numpy()
            change = np.flatnonzero(np.diff(keys)) + 1
            begins = np.concatenate([[0], change])
            local = np.arange(size) - np.repeat(begins, np.diff(np.append(begins, size)))
            end = change[0] if len(change) else size
            if last is not None and keys[0] == last:
                local[:end] += run
            elif last is not None:
                first = False
            opening = np.zeros(size, bool)
            opening[:end] = first
            first = first and not len(change)
            last, run = keys[-1], int(local[-1]) + 1
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(local + 1, pa.int64()), pa.array(opening)],
                names=[*batch.schema.names[:-1], "_local", "_opening"],
            )

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    local = materialise(dealt.mapInArrow(count, f"{shape}, _local bigint, _opening boolean"), "numbered")
    opened = local.filter("_opening").select(*group).distinct()
    parts = (
        local.alias("l")
        .join(F.broadcast(opened).alias("o"), _same("l", "o", group), "left_semi")  # a row a task at most
        .groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.sum("rows").over(earlier)).filter("before > 0").drop("rows")
    same = _same("l", "o", group) & (F.col("l._part") == F.col("o._part"))
    return (
        local.alias("l")
        .join(F.broadcast(offsets).alias("o"), same, "left")  # likewise
        .select(*[F.col(f"l.`{c}`") for c in columns], (F.col("_local") + F.coalesce("before", F.lit(0))).alias(name))
    )


def _same(left: str, right: str, group: list[str]) -> Column:
    condition = F.lit(True)
    for column in group:
        condition = condition & F.col(f"{left}.`{column}`").eqNullSafe(F.col(f"{right}.`{column}`"))
    return condition


def id_digests(members: DataFrame, keys: list[str], member: str, name: str) -> DataFrame:
    """(keys, name): SHA-256 of each group's decimal members, ascending and comma-joined.

    Ranges of sorted members become pieces of text in many tasks. Only the hash
    itself, which is sequential by nature, reads the pieces of a group one after
    another, as a stream. Keys are whole numbers without nulls.
    """
    shape = ", ".join(f"{key} bigint" for key in keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(len(keys) + 1)]
            change = np.zeros(batch.num_rows, bool)
            for column in columns[:-1]:
                change[1:] |= column[1:] != column[:-1]
            change[0] = True
            begins = np.flatnonzero(change)
            ends = np.append(begins[1:], batch.num_rows)
            texts = columns[-1].astype(str)
            joined = [",".join(texts[b:e]) for b, e in zip(begins, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column[begins]) for column in columns] + [pa.array(joined)],
                names=[*keys, "first", "text"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done, sums = None, None, [], []
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(len(keys))], batch.column(len(keys) + 1).to_pylist())
            for *key, text in rows:
                if key == held:
                    state.update(b",")
                else:
                    if held is not None:
                        done.append(held)
                        sums.append(state.hexdigest())
                    held, state = key, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield _rows(done, sums)
                done, sums = [], []
        if held is not None:
            yield _rows([held], [state.hexdigest()])

    def _rows(done: list[list[int]], sums: list[str]) -> pa.RecordBatch:
        columns = [pa.array([row[i] for row in done], pa.int64()) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sums)], names=[*keys, name])

    texts = (
        members.select(*keys, member)
        .repartitionByRange(*keys, member)
        .sortWithinPartitions(*keys, member)
        .mapInArrow(pieces, f"{shape}, first bigint, text string")
    )
    return (
        texts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{shape}, {name} string")
    )
