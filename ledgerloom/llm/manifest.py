"""A Merkle manifest of a corpus: bitmap ranks give leaves their places, slot arrays become levels.

Every document's leaf is a SHA-256 of its columns. The ids of each language form
compressed bitmaps, one for every 65,536 ids in a row: tasks build them from their
own rows, and those of one range are merged. A leaf's place among its language's
leaves is the number of smaller ids, which is a rank query: leaves in smaller ranges
by a directory of prefix sums, kept in steps of 16 bits so that no sum runs over more
than 65,536 rows, and within the range the counts of earlier 64-bit words plus the
bits below. No group is ever sorted. Repeated ids, which a bitmap cannot hold twice,
stand beside it with their numbers, and only their rows are ordered among themselves.

Places then key slot arrays of ``SLOTS`` nodes, each of which is reduced by as many
levels as it has bits, so a tree of n leaves needs log n / 10 rounds of a shuffle.
Going back down, each array adds its part to the path above it; the leaves' arrays
are proved last, with their own siblings and the path above.

Defined results: null columns count as "-"; a null id sorts before all ids; rows that
repeat an id are ordered by their leaves, and equal rows in any order, each with a
place of its own; a null language is a language, the first one; an empty table gives
no rows. Columns besides doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.order import numbered
from ledgerloom.session import materialise

RANGE = 16  # bits of an id that a bitmap covers, and that a step of the directory sums over
BITS = 10
SLOTS = 1 << BITS
ARITY = 2
TAMPERED = 7
SPARSE = 4096  # ids beyond which a bitmap is smaller than a list
HELD = 4096  # partial bitmaps in a task before it hands them on
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(column: Column) -> Column:
    """A value with its length in bytes, or "-" for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(frame: DataFrame, **changed: Column) -> Column:
    columns = [changed.get(name, F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, forged): every document's leaf, and the one its tampered row has."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lang",
        leaf(docs).alias("leaf"),
        F.when(tampered, leaf(docs, n_chars=more)).alias("forged"),
    )


def packed(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as a list or, where that is smaller, a bitmap."""
    if len(low) <= SPARSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << RANGE, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of ``packed``; only a bitmap has its length."""
    if len(data) < (1 << RANGE) // 8:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


# SPARSE numbers fill as many bytes as a bitmap; that length means a bitmap.
assert SPARSE * 2 == (1 << RANGE) // 8
SPARSE -= 1

BITMAP = "lang string, high bigint, ids binary, again array<bigint>, copies array<bigint>"
BITMAP_NAMES = ["lang", "high", "ids", "again", "copies"]


def _bitmap_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=BITMAP_NAMES)


def partial_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, high, ids, again, copies) of a task's own rows; ``copies`` counts the ids ``again``."""
    held: dict[tuple, list[np.ndarray]] = {}

    def done() -> pa.RecordBatch:
        rows = []
        for (lang, high), parts in held.items():
            low, count = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            rows.append((lang, high, packed(low), low[count > 1], count[count > 1]))
        held.clear()
        return _bitmap_batch(rows)

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary.to_pylist() + [None]
        code = langs.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        high, low = ids >> RANGE, ids & ((1 << RANGE) - 1)
        order = np.lexsort((low, high, code))
        code, high, low = code[order], high[order], low[order]
        cuts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(high, prepend=high[0] - 1) != 0))
        for begin, end in zip(cuts, np.append(cuts[1:], len(code))):
            found, count = np.unique(low[begin:end], return_counts=True)
            held.setdefault((names[code[begin]], int(high[begin])), []).append((found, count))
            size += len(found)
        if len(held) > HELD or size > HELD << 8:
            yield done()
            size = 0
    yield done()


def _summed(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(low, return_inverse=True)
    return distinct, np.bincount(at, weights=None if count is None else count, minlength=len(distinct)).astype(np.int64)


def merge_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (lang, high) of sorted partial bitmaps; reads them as a stream."""
    key, total, rows = None, np.zeros(1 << RANGE, np.int64), []

    def take() -> None:
        low = np.flatnonzero(total)
        count = total[low]
        rows.append((*key, packed(low), low[count > 1], count[count > 1]))
        total[:] = 0

    for batch in batches:
        plain = [batch.column(i).to_pylist() for i in range(3)]
        again, copies = batch.column(3), batch.column(4)
        for i, (lang, high, ids) in enumerate(zip(*plain)):
            if key is not None and key != (lang, high):
                take()
            key = (lang, high)
            total[unpacked(ids)] += 1
            total[again[i].values.to_numpy()] += copies[i].values.to_numpy() - 1
        if len(rows) > 256:
            yield _bitmap_batch(rows)
            rows.clear()
    if key is not None:
        take()
    yield _bitmap_batch(rows)


def bitmaps(rows: DataFrame) -> DataFrame:
    """The merged bitmap of every language and range of ids."""
    partial = rows.select("lang", "doc_id").filter(F.col("doc_id").isNotNull()).mapInArrow(partial_bitmaps, BITMAP)
    dealt = partial.repartition("lang", "high").sortWithinPartitions("lang", "high")
    return dealt.mapInArrow(merge_bitmaps, BITMAP)


def directory(merged: DataFrame, nulls: DataFrame) -> DataFrame:
    """(lang, high, base): leaves of the language before each range, null ids first.

    ``high`` has 48 bits, of which each step sums 16: ranges under one parent,
    then parents under theirs. So a window never holds more than 65,536 rows.
    """
    ids = F.when(F.octet_length("ids") == (1 << RANGE) // 8, F.bitmap_count(F.col("ids"))).otherwise(
        F.octet_length("ids") / 2
    )
    repeated = F.aggregate("copies", F.lit(0).cast("bigint"), lambda total, n: total + n - 1)
    level = merged.select("lang", F.col("high").alias("node"), (ids.cast("bigint") + repeated).alias("rows"))
    steps = []
    for _ in range(3):
        up = F.shiftright("node", RANGE)
        smaller = Window.partitionBy("lang", up).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        steps.append(level.select("lang", "node", F.coalesce(F.sum("rows").over(smaller), F.lit(0)).alias("before")))
        level = level.groupBy("lang", up.alias("node")).agg(F.sum("rows").alias("rows"))
    base = merged.select("lang", "high").withColumn("base", F.lit(0).cast("bigint"))
    for i, step in enumerate(steps):
        named = step.select(F.col("lang").alias("_lang"), F.col("node").alias("_node"), "before")
        on = F.col("lang").eqNullSafe(F.col("_lang")) & (F.shiftright("high", RANGE * i) == F.col("_node"))
        base = base.join(named, on).select("lang", "high", (F.col("base") + F.col("before")).alias("base"))
    # After three steps a node is the sign of its ids: 0, or -1 for negative ones, which come first.
    below = level.filter("node < 0").groupBy("lang").agg(F.sum("rows").alias("negative"))
    shift = nulls.join(below.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    shift = shift.select(
        F.col("lang").alias("_lang"), "nulls", F.coalesce("negative", F.lit(0)).alias("negative")
    )
    moved = F.col("base") + F.col("nulls") + F.when(F.col("high") >= 0, F.col("negative")).otherwise(0)
    return base.join(shift, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "high", moved.alias("base"))


RANKED = "lang string, doc_id bigint, leaf binary, forged binary, place bigint, again boolean"


def rank_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of leaves, which follow their range's bitmap in the stream (``ids`` is null for leaves)."""
    base, words, before, again, extra = 0, None, None, None, None
    for batch in batches:
        lang, high, ids, repeated, copies, start, doc, leaf_, forged = (batch.column(i) for i in range(9))
        maps = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        docs = doc.fill_null(0).to_numpy(zero_copy_only=False)
        place, more = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
        for begin, end in zip([-1, *maps], [*maps, batch.num_rows]):
            if begin >= 0:
                base = start[begin].as_py()
                bits = np.zeros(1 << RANGE, np.uint8)
                bits[unpacked(ids[begin].as_py())] = 1
                words = np.packbits(bits, bitorder="little").view("<u8")
                before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
                again = repeated[begin].values.to_numpy()
                extra = np.concatenate([[0], np.cumsum(copies[begin].values.to_numpy() - 1)])
            if end > begin + 1:
                low = docs[begin + 1 : end] & ((1 << RANGE) - 1)
                under = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
                rank = before[low >> 6] + np.bitwise_count(words[low >> 6] & under)
                at = np.searchsorted(again, low)
                place[begin + 1 : end] = base + rank + extra[at]
                there = np.minimum(at, max(len(again) - 1, 0))
                more[begin + 1 : end] = again[there] == low if len(again) else False
        keep = pa.array(np.setdiff1d(np.arange(batch.num_rows), maps))
        columns = [lang, doc, leaf_, forged, pa.array(place), pa.array(more)]
        yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], names=["lang", "doc_id", "leaf", "forged", "place", "again"])


def placed(rows: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, forged, place): every leaf with its place from 0 in its language."""
    merged = materialise(bitmaps(rows), "bitmaps")
    counts = rows.groupBy("lang").agg(F.sum(F.col("doc_id").isNull().cast("bigint")).alias("nulls"))
    base = directory(merged, counts).withColumnsRenamed({"lang": "_lang", "high": "_high"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("high") == F.col("_high"))
    maps = merged.join(base, same).select("lang", "high", "ids", "again", "copies", "base")
    none = F.lit(None)
    known = rows.filter(F.col("doc_id").isNotNull())
    found = known.select(
        "lang", F.shiftright("doc_id", RANGE).alias("high"), none.cast("binary").alias("ids"),
        none.cast("array<bigint>").alias("again"), none.cast("array<bigint>").alias("copies"),
        none.cast("bigint").alias("base"), "doc_id", "leaf", "forged",
    )
    heads = maps.withColumns(
        {"doc_id": none.cast("bigint"), "leaf": none.cast("binary"), "forged": none.cast("binary")}
    )
    # A bitmap and its leaves go to one task, the bitmap first.
    stream = (
        heads.unionByName(found)
        .repartition("lang", "high")
        .sortWithinPartitions("lang", "high", F.col("ids").isNull())
    )
    ranked = materialise(stream.mapInArrow(rank_leaves, RANKED), "ranked")
    unknown = rows.filter(F.col("doc_id").isNull()).select(
        "lang", "doc_id", "leaf", "forged", F.lit(0).cast("bigint").alias("place"), F.lit(True).alias("again")
    )
    several = ranked.filter("again").unionByName(unknown)
    ordered = numbered(several.drop("again"), ["lang", "doc_id"], [F.col("leaf")], "nth")
    ordered = ordered.withColumn("place", F.col("place") + F.col("nth") - 1).drop("nth")
    return ranked.filter("NOT again").drop("again").unionByName(ordered)


def _parents(nodes: list[bytes]) -> list[bytes]:
    return [
        hashlib.sha256("".join(n.hex() for n in nodes[i : i + ARITY]).encode()).digest()
        for i in range(0, len(nodes), ARITY)
    ]


def levels(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels above a slot array: down to one node in a whole tree, else as many as a full array has."""
    found = [nodes]
    while len(found[-1]) > 1 if whole else len(found) <= BITS:
        found.append(_parents(found[-1]))
    return found


def slots(batch: pa.RecordBatch, row: int, size: int) -> list[bytes]:
    """The digests of one array, each put where its place says."""
    places = batch.column("places")[row].values.to_numpy() & (SLOTS - 1)
    filled = [b""] * size
    for at, node in zip(places, batch.column("nodes")[row].values.to_pylist()):
        filled[at] = node
    return filled


def arrays(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, slot, whole, places, nodes): slot arrays keyed by (tree, slot), from (tree, place, node, rows).

    ``rows`` is the number of nodes on the level; ``more`` columns become arrays too.
    """
    listed = F.collect_list(F.struct("place", "node", *more))
    return (
        nodes.groupBy("tree", F.shiftright("place", BITS).alias("slot"))
        .agg(listed.alias("all"), (F.max("rows") <= SLOTS).alias("whole"), F.max("rows").alias("rows"))
        .select("tree", "slot", "whole", "rows", F.col("all.place").alias("places"), F.col("all.node").alias("nodes"),
                *[F.col(f"all.{name}").alias(name) for name in more])
    )


def reduce_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, place, node): the node above each slot array."""
    for batch in batches:
        whole = batch.column("whole").to_pylist()
        tops = []
        for row in range(batch.num_rows):
            size = len(batch.column("places")[row])
            tops.append(levels(slots(batch, row, size), whole[row])[-1][0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("slot"), pa.array(tops, pa.binary())], names=["tree", "place", "node"]
        )


def _siblings(found: list[list[bytes]], at: int) -> tuple[list[bytes], list[bytes]]:
    """(left, right) siblings of a slot, level by level, each as one hex text."""
    left, right = [], []
    for level in found[:-1]:
        begin = at - at % ARITY
        left.append("".join(n.hex() for n in level[begin:at]).encode())
        right.append("".join(n.hex() for n in level[at + 1 : begin + ARITY]).encode())
        at //= ARITY
    return left, right


PATHS = "tree bigint, place bigint, left array<binary>, right array<binary>, root binary"


def descend_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, place, left, right, root) of every node of the arrays: its own siblings and those above."""
    for batch in batches:
        plain = {name: batch.column(name).to_pylist() for name in ("tree", "slot", "whole", "left", "right", "root")}
        for row in range(batch.num_rows):
            places = batch.column("places")[row].values.to_numpy()
            found = levels(slots(batch, row, len(places)), plain["whole"][row])
            lefts, rights = [], []
            for place in places:
                left, right = _siblings(found, int(place) & (SLOTS - 1))
                lefts.append(left + (plain["left"][row] or []))
                rights.append(right + (plain["right"][row] or []))
            root = plain["root"][row] or found[-1][0]
            size = len(places)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([plain["tree"][row]] * size, pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array(lefts, pa.list_(pa.binary())),
                    pa.array(rights, pa.list_(pa.binary())),
                    pa.array([root] * size, pa.binary()),
                ],
                names=["tree", "place", "left", "right", "root"],
            )


PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The manifest's rows of the leaves' slot arrays."""
    for batch in batches:
        plain = {name: batch.column(name).to_pylist() for name in ("whole", "subroot", "left", "right", "root")}
        for row in range(batch.num_rows):
            places = batch.column("places")[row].values.to_numpy() & (SLOTS - 1)
            nodes = batch.column("nodes")[row].values.to_pylist()
            found = levels(slots(batch, row, len(places)), plain["whole"][row])
            above_left, above_right = plain["left"][row] or [], plain["right"][row] or []
            root = plain["root"][row] or found[-1][0]
            subroot = plain["subroot"][row] or found[-1][0]
            above = b"".join(part for pair in zip(above_left, above_right) for part in pair)
            proofs, folded = [], []
            for place, node, forged in zip(places, nodes, batch.column("forged")[row].values.to_pylist()):
                left, right = _siblings(found, int(place))
                proofs.append(hashlib.sha256(b"".join(p for pair in zip(left, right) for p in pair) + above).hexdigest())
                text = (forged or node).hex().encode()
                for before, after in zip(left + above_left, right + above_right):
                    text = hashlib.sha256(before + text + after).hexdigest().encode()
                folded.append(text.decode())
            size, top = len(places), root.hex()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[row].values,
                    pa.array([node.hex() for node in nodes]),
                    pa.array([subroot.hex()] * size),
                    pa.array([top] * size),
                    pa.array(proofs),
                    pa.array(folded),
                    pa.array([text == top for text in folded]),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


class Level:
    """Slot arrays of one level of all trees, and the nodes above them."""

    def __init__(self, nodes: DataFrame, *more: str) -> None:
        self.arrays = materialise(arrays(nodes, *more), "slots")
        tops = self.arrays.select("tree", "slot", "whole", "places", "nodes").mapInArrow(
            reduce_arrays, "tree bigint, place bigint, node binary"
        )
        counts = self.arrays.select("tree", F.col("slot").alias("place"), "whole", F.col("rows").alias("_rows"))
        joined = tops.join(counts, ["tree", "place"])
        rows = F.floor((F.col("_rows") + (SLOTS - 1)) / F.lit(SLOTS))
        self.tops = materialise(joined.select("tree", "place", "node", "whole", rows.alias("rows")), "tops")

    def above(self) -> DataFrame:
        return self.tops.filter("NOT whole").drop("whole")

    def roots(self) -> DataFrame:
        return self.tops.filter("whole").select("tree", "node")


def climb(nodes: DataFrame, *more: str) -> tuple[list[Level], DataFrame]:
    """The levels of all trees, and (tree, node) of their roots."""
    found = [Level(nodes, *more)]
    roots = found[0].roots()
    while not found[-1].above().isEmpty():
        found.append(Level(found[-1].above()))
        roots = roots.unionByName(found[-1].roots())
    return found, roots


def with_paths(level: Level, paths: DataFrame | None, tops: DataFrame | None) -> DataFrame:
    """Arrays with what is above them: the path of their own top, or for whole trees of ``tops``."""
    none = F.lit(None)
    known = level.arrays
    empty = {"left": none.cast("array<binary>"), "right": none.cast("array<binary>"), "root": none.cast("binary")}
    whole, parts = known.filter("whole"), known.filter("NOT whole")
    whole = whole.withColumns(empty) if tops is None else whole.join(tops, "tree", "left")
    if paths is None:
        return whole
    inner = paths.withColumnRenamed("place", "slot")
    return whole.unionByName(parts.join(inner, ["tree", "slot"]).select(whole.columns))


def descend(found: list[Level], tops: DataFrame | None) -> DataFrame | None:
    """(tree, place, left, right, root) of the tops of the lowest level's arrays."""
    paths = None
    for level in reversed(found[1:]):
        paths = materialise(with_paths(level, paths, tops).mapInArrow(descend_arrays, PATHS), "paths")
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document."""
    rows = materialise(leaves(docs), "leaves")
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # Languages in order, null first; few or many, they are numbered like any group.
    named = counted.withColumn("_all", F.lit(0))
    trees = materialise(
        numbered(named, ["_all"], [F.col("lang").asc_nulls_first()], "tree").withColumn("tree", F.col("tree") - 1), "trees"
    )
    kept = trees.select(F.col("lang").alias("_lang"), "tree", "rows")
    nodes = placed(rows).join(kept, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "tree", "place", F.col("leaf").alias("node"), "rows", "doc_id", "forged"
    )
    found, roots = climb(nodes, "doc_id", "forged")
    subroots = materialise(roots, "subroots")
    total = trees.count()
    upper, _ = climb(
        subroots.select(
            F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), "node", F.lit(total).cast("bigint").alias("rows")
        )
    )
    over = with_paths(upper[0], descend(upper, None), None).mapInArrow(descend_arrays, PATHS)
    tops = materialise(over.select(F.col("place").alias("tree"), "left", "right", "root"), "tops")
    last = with_paths(found[0], descend(found, tops), tops)
    subroot = subroots.withColumnRenamed("node", "subroot")
    return last.join(subroot, "tree").mapInArrow(prove_arrays, PROVED)


def oracle() -> str:
    """All levels by recursion, as SQL for the checking engine."""
    from ledgerloom.llm.radix import crc32_sql

    def text(more: str = "") -> str:
        parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in
                 ("doc_id::VARCHAR", "source", "lang", f"(n_chars{more})::VARCHAR", "text")]
        return f"sha256({' || '.join(parts)})"

    def climbing(name: str, start: str) -> str:
        return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT tree, h + 1, i // {ARITY}, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + {ARITY - 1}) // {ARITY}
  FROM {name} WHERE n > 1 GROUP BY tree, h, i // {ARITY})"""

    def path(levels_: str, kind: str, tree: str, at: str) -> str:
        return f"""SELECT r.row, {kind} + v.h AS step, v.i, v.node, v.i < r.{at} // CAST(pow({ARITY}, v.h) AS BIGINT) AS before
  FROM rows r JOIN {levels_} v ON v.tree = {tree} AND v.n > 1
   AND v.i // {ARITY} = r.{at} // CAST(pow({ARITY}, v.h + 1) AS BIGINT) AND v.i <> r.{at} // CAST(pow({ARITY}, v.h) AS BIGINT)"""

    return f"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {text()} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % {TAMPERED} = 0
              THEN {text(" + 1")} ELSE {text()} END AS start
  FROM documents),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS size, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM given),
{climbing("low", "SELECT tree, 0 AS h, place AS i, leaf AS node, size AS n FROM rows")},
subroots AS (SELECT tree, node FROM low WHERE n = 1),
{climbing("top", "SELECT 0 AS tree, 0 AS h, tree AS i, node, (SELECT count(*) FROM subroots) AS n FROM subroots")},
steps AS (
  SELECT DISTINCT r.row, v.h AS step FROM rows r JOIN low v ON v.tree = r.tree AND v.n > 1
  UNION SELECT DISTINCT r.row, 1000 + v.h FROM rows r, top v WHERE v.n > 1),
paths AS (
  {path("low", "0", "r.tree", "place")}
  UNION ALL
  {path("top", "1000", "0", "tree")}),
sides AS (
  SELECT s.row, s.step, coalesce(string_agg(node, '' ORDER BY i) FILTER (before), '') AS a,
         coalesce(string_agg(node, '' ORDER BY i) FILTER (NOT before), '') AS b
  FROM steps s LEFT JOIN paths p ON p.row = s.row AND p.step = s.step GROUP BY s.row, s.step),
proofs AS (SELECT row, string_agg(a || b, '' ORDER BY step) AS proof,
                  list({{'a': a, 'b': b}} ORDER BY step) AS sides FROM sides GROUP BY row),
folded AS (
  SELECT r.row, start AS node, sides, 1 AS k FROM rows r LEFT JOIN proofs p ON p.row = r.row
  UNION ALL
  SELECT row, sha256(sides[k].a || node || sides[k].b), sides, k + 1 FROM folded WHERE k <= len(sides)),
ends AS (SELECT row, arg_max(node, k) AS node FROM folded GROUP BY row)
SELECT r.doc_id, r.leaf, s.node AS subroot, t.node AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       e.node AS folded_root, e.node = t.node AS verified
FROM rows r JOIN subroots s ON s.tree = r.tree JOIN top t ON t.n = 1
JOIN ends e ON e.row = r.row LEFT JOIN proofs p ON p.row = r.row
"""
