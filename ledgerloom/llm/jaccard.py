"""Similar documents by the Jaccard index of their word shingles: a parity-sketch join.

Each distinct shingle flips one bit of a very wide, sparse sketch, so the Hamming
distance of two sketches never exceeds the symmetric difference of the sets. Sets
at or above the threshold differ in at most d elements, d following from their
sizes; of d + 1 + m blocks of the sketch at least m + 1 are therefore equal. Each
size band has its own d, and a document joins its band and those below that
hold sets similar enough in size. A block travels as the xor of random codes of
its set bits. Blocks without elements say nothing and are left out of the join
unless a document has more than m of them, which keeps the argument exact. Equal
blocks are candidates; those whose short sketches differ in too many bits are
dropped, and the others are verified on the whole sets.

Equal sets become one class, so copies never meet in a block. A set that shares
fewer blocks of a band with all others together than it must with one linked set is
left out, so passages that many texts quote do not keep their texts in the join. The
others meet again in the rarest of their shingles, of which each takes only as many
as a linked set cannot miss. Among the sets of such a shingle those of lowest rank,
with the fewest shingles of their own, are compared with the rest, in rounds of
growing size, and a set is finished as soon as all it could link with are connected
to it: a large group of near copies costs a few comparisons per member, and copies
changed beyond the threshold by shingles of their own meet no other. Copies that
share their changes do get compared with each other. No pair that could change a
component is skipped.

Defined results: null, empty and blank texts have no shingles and link with
nothing; a text with fewer words than a shingle is one shingle; rows that repeat
an id with the same text change nothing; an id is meant to name one text, and
where it names several, each row keeps its own size and one component; a row
with a null id links with nothing and its component is null; an empty table
gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.graph import components
from ledgerloom.llm.skew import spread_join
from ledgerloom.llm.words import Splitter, in_batches, mix, sequence_hash, stretches
from ledgerloom.session import materialise, release


class Shingles:
    """Sorted distinct shingle hashes of each text of a batch."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.splitter = Splitter(lower=True)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in stretches(texts):
            words = self.splitter.split(data, offsets)
            total = max(0, len(words.hashes) - self.width + 1)
            full = sequence_hash(words.hashes, np.arange(total), self.width)
            for begin, end in zip(words.bounds[:-1], words.bounds[1:]):
                if end - begin >= self.width:
                    yield np.unique(full[begin : end - self.width + 1])
                elif end > begin:
                    yield sequence_hash(words.hashes, np.array([begin]), end - begin, seed=1)
                else:
                    yield np.zeros(0, np.uint64)


def size_bands(numerator: int, denominator: int, growth: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the size bands, and the most elements by which two linked sets differ in each.

    Two sets of J >= n/d, the smaller of them in the band, differ in at most
    (d - n) / (d + n) times the sum of their sizes.
    """
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * growth))))
    highest = [low - 1 for low in lows[1:]] + [1 << 62]
    apart = [
        (high + high * denominator // numerator) * (denominator - numerator) // (denominator + numerator)
        for high in highest
    ]
    return np.array(lows), apart


BAND_BITS = 7


def block_keys(
    hashes: np.ndarray, lows: np.ndarray, apart: list[int], numerator: int, denominator: int
) -> tuple[np.ndarray, np.ndarray]:
    """The keys of sketch blocks and their marks, for each band in which the set may have a partner.

    The hashes are sorted, and a block takes an equal share of their range, so
    the parity of a block is one xor over neighbours. A mark holds the band in its
    low bits and above them how many of these keys a partner has at least: all blocks
    but ``apart`` are equal, of which those empty here may not be sent.
    """
    keys, marks = [], []
    top, codes = hashes >> np.uint64(32), mix(hashes)
    for band in bands_of(len(hashes), lows, numerator, denominator):
        spare = -(-apart[band] // 5)
        filled, empty = blocks(top, codes, apart[band] + 1 + spare, band)
        keys.append(filled if len(empty) <= spare else np.concatenate([filled, empty]))
        least = max(1, spare + 1 - len(empty))
        marks.append(np.full(len(keys[-1]), (least << BAND_BITS) + band, np.int64))
    return np.concatenate(keys), np.concatenate(marks)


def bands_of(size: int, lows: np.ndarray, numerator: int, denominator: int) -> range:
    """The bands in which a set of this size may be the smaller or the larger of two linked sets."""
    own = int(np.searchsorted(lows, size, side="right")) - 1
    least = int(np.searchsorted(lows, -(-numerator * size // denominator), side="right")) - 1
    return range(least, own + 1)


def blocks(top: np.ndarray, codes: np.ndarray, count: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the blocks with elements, and of those without."""
    block = (top * np.uint64(count)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(block, prepend=np.uint64(1 << 63)))
    place, parity = block[cuts], np.bitwise_xor.reduceat(codes, cuts)
    empty = np.setdiff1d(np.arange(count, dtype=np.uint64), place)
    return (
        mix(parity + mix(place * np.uint64(64) + np.uint64(band))),
        mix(mix(empty * np.uint64(64) + np.uint64(band))),
    )


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    low = np.bitwise_xor.reduce(hashes, initial=np.uint64(0))
    return int(low), int(np.sum(mix(hashes), dtype=np.uint64))


SKETCH = [f"s{i}" for i in range(8)]


def short_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of a set folded to 512 bits, as eight numbers."""
    places = (mix(hashes + np.uint64(1)) >> np.uint64(55)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=512) & 1).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, low, high, s0 ... s7): size, name and short sketch of each document's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            sets = list(shingles.sets(batch.column(1)))
            names = np.array([set_name(hashes) for hashes in sets], np.uint64).reshape(len(sets), 2)
            sketches = np.array([short_sketch(hashes) for hashes in sets], np.int64).reshape(len(sets), 8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(hashes) for hashes in sets], pa.int64()),
                    *[pa.array(np.ascontiguousarray(names[:, i]).view(np.int64)) for i in (0, 1)],
                    *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(8)],
                ],
                names=["doc_id", "n", "low", "high", *SKETCH],
            )

    return in_batches(docs).select("doc_id", "text").mapInArrow(
        sign, "doc_id bigint, n bigint, low bigint, high bigint, " + ", ".join(f"{s} bigint" for s in SKETCH)
    )


def sketch_keys(docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """(key, doc_id, mark) of every sketch block of every document with a set.

    A task sends the blocks of equal sets once.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        lows, apart = size_bands(numerator, denominator)
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, owners, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, hashes in enumerate(shingles.sets(batch.column(1))):
                name = set_name(hashes)
                if len(hashes) and name not in sent:
                    sent.add(name)
                    for made, of in zip((keys, marks), block_keys(hashes, lows, apart, numerator, denominator)):
                        made.append(of)
                    owners.append(np.full(len(keys[-1]), ids[row], np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate(owners)),
                    pa.array(np.concatenate(marks)),
                ],
                names=["key", "doc_id", "mark"],
            )

    known = in_batches(docs).select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    return known.mapInArrow(emit, "key bigint, doc_id bigint, mark bigint")


def rare_shingles(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(key, rep, n, reach, alone) of the rarest shingles of each set, as many as two linked sets cannot miss.

    All shingles are put in one order, those of fewer sets first. What stands in a set
    before the first shingle it shares with another is missing there. A linked set of
    size m lacks at most half of (d - k) / (d + k) * (n + m) + n - m of n shingles, at
    k / d the threshold, so each place in the order has a largest m, the ``reach``.
    ``alone`` counts the shingles no other set has, which meet nothing: a copy changed
    beyond the threshold has more of them than it may and meets no other copy.
    """
    return (
        sets.select(
            F.col("doc_id").alias("rep"),
            F.xxhash64("shingles").alias("name"),
            F.size("shingles").cast("bigint").alias("n"),
            "shingles",
        )
        .select(F.explode("shingles").alias("key"), "rep", "name", "n")
        .repartition("key")
        .distinct()
        .withColumn("holders", F.count("*").over(Window.partitionBy("key")))
        .filter("holders > 1")
        .groupBy("rep", "name", "n")
        .agg(F.array_sort(F.collect_list(F.struct("holders", "key"))).alias("order"))
        .withColumn("alone", F.col("n") - F.size("order"))
        .withColumn("most", F.expr(f"n * {denominator - numerator} div {denominator}"))
        .withColumn("take", F.greatest(F.col("most") - F.col("alone") + 1, F.lit(0)).cast("int"))
        .withColumn("order", F.slice("order", F.lit(1), F.col("take")))
        .select("rep", "n", "alone", F.posexplode("order").alias("place", "held"))
        .withColumn("place", F.col("place") + F.col("alone"))
        .select(
            F.col("held.key").alias("key"),
            "rep",
            "n",
            F.expr(f"(n * {denominator} - place * {denominator + numerator}) div {numerator}").alias("reach"),
            "alone",
        )
    )


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct shingle hashes of each document."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            sets = list(shingles.sets(batch.column(1)))
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "shingles"],
            )

    return in_batches(docs).select("doc_id", "text").mapInArrow(hashes, "doc_id bigint, shingles array<bigint>")


def _overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right)).cast("bigint")


def verify(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, in whole numbers."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = F.size("left").cast("bigint") + F.size("right")
    shared = _overlap(F.col("left"), F.col("right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), shared.alias("shared"))
        .filter(F.col("shared") * denominator >= (F.col("both") - F.col("shared")) * numerator)
        .select("a", "b")
    )


def similar_documents(
    docs: DataFrame, width: int = 5, numerator: int = 8, denominator: int = 10
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Documents link when the Jaccard index of their shingle sets is at least
    numerator / denominator; a component is named by its smallest doc_id.
    """
    signed = materialise(signatures(docs, width), "signatures")
    identified = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    name = ["low", "high", "n"]
    # A set of one document represents itself; only shared sets take part in the join.
    classes = identified.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    shared_sets = classes.filter("size > 1").drop("size")
    members = materialise(
        spread_join(identified, shared_sets, name, "doc_id")
        .select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n", *SKETCH)
        .distinct(),
        "members",
    )
    same = Window.partitionBy("key")
    shared = (
        sketch_keys(docs, width, numerator, denominator)
        .withColumn("other", F.min("doc_id").over(same) < F.max("doc_id").over(same))
        .filter("other")
        .select("key", "doc_id", "mark")
    )
    # Three numbers a row: sizes and sketches join the far fewer pairs, not the blocks.
    near = materialise(
        shared.join(members.select("doc_id", "rep"), "doc_id")
        .select("key", "rep", "mark")
        .repartition("key")
        .distinct()
        .withColumn("other", F.min("rep").over(same) < F.max("rep").over(same))
        .filter("other")
        .groupBy("rep", "mark")
        .agg(F.count("*").alias("met"))
        .filter(F.col("met") >= F.shiftright("mark", BAND_BITS))
        .select(F.col("rep").alias("doc_id"))
        .distinct(),
        "near",
    )
    release()  # the shuffle of all block keys has been read
    # Texts are shuffled and cut once more, for those that met another.
    texts = docs.select("doc_id", "text").join(near, "doc_id", "left_semi")
    sets = materialise(shingle_sets(texts, width), "sets")
    release(near)
    rank = F.row_number().over(same.orderBy("alone", "rep")) - 1
    ranked = materialise(
        rare_shingles(sets, numerator, denominator)
        .withColumn("rank", rank.cast("int"))
        .withColumn("last", F.max("rank").over(same))
        .filter("last > 0")
        .drop("alone", "last"),
        "ranked",
    )
    release()
    sketches = members.filter(F.col("doc_id") == F.col("rep")).select("rep", "n", *SKETCH)
    linked = connect(ranked, sketches, sets, numerator, denominator)
    release(ranked, sets)

    by_class = (
        members.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    )
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(by_class, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def promising(pairs: DataFrame, sketches: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sizes and short sketches allow the threshold.

    The sketches differ in no more bits than the sets in elements.
    """
    first = sketches.select(
        F.col("rep").alias("a"), F.col("n").alias("n_a"), *[F.col(s).alias(f"{s}_a") for s in SKETCH]
    )
    differ = reduce(Column.__add__, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"{s}_a"))) for s in SKETCH])
    apart = (F.col("n") + F.col("n_a")) * (denominator - numerator)
    return (
        pairs.join(first, "a")
        .join(sketches.withColumnRenamed("rep", "b"), "b")
        .filter(F.least("n", "n_a") * denominator >= F.greatest("n", "n_a") * numerator)
        .filter(differ * (denominator + numerator) <= apart)
        .select("a", "b")
    )


def undecided(state: DataFrame) -> DataFrame:
    """The members of blocks that may still meet one of another component, by its size and theirs.

    Of the smallest size and the farthest reach of a block, the best and the best of
    another component than that one's are enough to know.
    """
    block = Window.partitionBy("key")
    return (
        state.withColumn("least", F.min(F.struct("n", "component")).over(block))
        .withColumn("most", F.max(F.struct("reach", "component")).over(block))
        .withColumn("least2", F.min(F.when(F.col("component") != F.col("least.component"), F.col("n"))).over(block))
        .withColumn("most2", F.max(F.when(F.col("component") != F.col("most.component"), F.col("reach"))).over(block))
        .filter(
            F.when(F.col("component") == F.col("least.component"), F.col("least2")).otherwise(F.col("least.n"))
            <= F.col("reach")
        )
        .filter(
            F.when(F.col("component") == F.col("most.component"), F.col("most2")).otherwise(F.col("most.reach"))
            >= F.col("n")
        )
        .drop("least", "most", "least2", "most2")
    )


def connect(
    ranked: DataFrame, sketches: DataFrame, sets: DataFrame, numerator: int, denominator: int
) -> DataFrame:
    """(node, component) of the verified links among documents that share a block.

    The first round compares the first member of every block with the others,
    each later round eight times as many members, among those that may still
    meet another component. It ends when no block has such members left.
    """
    in_block = Window.partitionBy("key")
    named, state, low, high = None, None, 0, 1
    while True:
        before = state
        if named is None:
            state = ranked.withColumn("component", F.col("rep"))
        else:
            state = materialise(
                undecided(
                    before.drop("component")
                    .join(named.withColumnRenamed("node", "rep"), "rep", "left")
                    .withColumn("component", F.coalesce("component", "rep"))
                )
                .withColumn("top", F.max("rank").over(in_block))
                .filter(F.col("top") > low)
                .drop("top"),
                "live",
            )
            if low > 1:
                release(before)
            if state.isEmpty():
                return named
        pivots = state.filter((F.col("rank") >= low) & (F.col("rank") < high)).select(
            "key", *[F.col(name).alias(f"{name}_a") for name in ("rep", "n", "reach", "rank", "component")]
        )
        pairs = (
            state.join(pivots, "key")
            .filter((F.col("rank") > F.col("rank_a")) & (F.col("component") != F.col("component_a")))
            .filter((F.col("n") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach")))
            .select(F.col("rep_a").alias("a"), F.col("rep").alias("b"))
            .distinct()
        )
        close = materialise(promising(pairs, sketches, numerator, denominator), "pairs")
        found = verify(close, sets, numerator, denominator)
        if named is not None:  # a component stays one through the star of its members
            found = found.unionByName(named.select(F.col("component").alias("a"), F.col("node").alias("b")))
        named = components(found)
        release(close)
        low, high = high, 8 * high + high


def oracle(width: int, numerator: int, denominator: int) -> str:
    """All pairs that share a shingle, as SQL for the checking engine."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, {run} AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width} + 2)) AS i FROM cut WHERE len(w) >= {width})
  UNION SELECT doc_id, array_to_string(w, ' ') FROM cut WHERE len(w) BETWEEN 1 AND {width - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
           FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
          WHERE {denominator} * k >= {numerator} * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""
