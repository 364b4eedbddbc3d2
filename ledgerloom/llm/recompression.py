"""Removal of repeated passages by recompression of the word sequence.

A text's words are names; rounds replace short runs of one name and pairs of
names by new names that depend on nothing but what they replace, so equal
substrings get equal symbols wherever they stand, except near their ends. Every
symbol carries the stretch of words that its making looked at. A window of words
is represented by the longest symbol whose stretch lies inside it (ties by hash,
then leftmost), a choice its words alone determine: equal windows have the same
symbol at the same place. So only symbols that occur twice can stand for
repeated windows, and consecutive windows with one symbol travel as one row.

Where all occurrences of a symbol agree on the whole stretch its windows cover,
they are copies and the first keeps its words. The other windows of shared
symbols are verified one by one by hash. Names are made by hashing, which is
the same for all tasks without a dictionary to ship.

Defined results: a null text has no words; texts shorter than a window lose
nothing; rows with a null id lose nothing and count as nobody's earlier
occurrence; rows repeating an id and text count as one document and get the same
result each; different texts under one id are documents of their own, in the
order of a hash of the text; an empty table gives no rows. Columns besides the id
and the text are not read. Text order is doc_id order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.identity import told_apart
from ledgerloom.llm.words import Splitter, in_batches, mix, row_of, stretches
from ledgerloom.session import materialise

ROUNDS = 3
LONGEST_RUN = 6
_PLACE = 26  # bits of a candidate's number in a selection key
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


class Level:
    """Symbols of one round, in text order; ``low:high`` is the stretch each depends on."""

    def __init__(self, name, begin, end, low, high, row) -> None:
        self.name, self.begin, self.end = name, begin, end
        self.low, self.high, self.row = low, high, row

    def take(self, keep) -> "Level":
        return Level(*(x[keep] for x in (self.name, self.begin, self.end, self.low, self.high, self.row)))


FAR = 1 << 40  # a bound that puts a symbol inside no window


def _neighbours(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Lowest dependence of the symbol before and highest of the one after; far beyond a text's ends."""
    before = np.full(len(level.name), -FAR)
    after = np.full(len(level.name), FAR)
    same = level.row[1:] == level.row[:-1]
    before[1:][same] = level.low[:-1][same]
    after[:-1][same] = level.high[1:][same]
    return before, after


def compress_runs(level: Level) -> tuple[Level, np.ndarray]:
    """Runs of one name become one symbol; which symbols are new.

    Whether a run is over shows only in its neighbours, so all symbols come to
    depend on these. Runs beyond the longest length stay apart and represent no
    window.
    """
    before, after = _neighbours(level)
    size = len(level.name)
    first = np.ones(size, bool)
    first[1:] = (level.name[1:] != level.name[:-1]) | (level.row[1:] != level.row[:-1])
    begin = np.flatnonzero(first)
    length = np.diff(begin, append=size)
    last = begin + length - 1
    short = length <= LONGEST_RUN
    merged = level.take(begin)
    merged.end = level.end[last]
    merged.low = np.minimum(level.low[begin], before[begin])
    merged.high = np.maximum(level.high[last], after[last])
    many = length > 1
    merged.name[many] = mix(merged.name[many] * _ODD + length[many].astype(np.uint64))
    if short.all():
        return merged, many
    loose = np.repeat(~short, length)
    alone = level.take(loose)
    alone.low[:], alone.high[:] = -FAR, FAR
    both = Level(*(np.concatenate(p) for p in zip(vars(merged.take(short)).values(), vars(alone).values())))
    order = np.argsort(both.begin, kind="stable")
    fresh = np.concatenate([many[short], np.zeros(loose.sum(), bool)])
    return both.take(order), fresh[order]


def compress_pairs(level: Level, seed: int) -> tuple[Level, np.ndarray]:
    """Names fall on a left and a right side; each left followed by a right becomes one symbol."""
    side = (mix(level.name + np.uint64(seed)) & np.uint64(1)).astype(bool)
    before, after = _neighbours(level)
    head = np.zeros(len(level.name), bool)
    head[:-1] = ~side[:-1] & side[1:] & (level.row[1:] == level.row[:-1])
    tail = np.zeros(len(level.name), bool)
    tail[1:] = head[:-1]
    out = level.take(slice(None))
    left = ~head & ~tail & ~side
    right = ~head & ~tail & side
    out.high = np.where(left, np.maximum(level.high, after), level.high)
    out.low = np.where(right, np.minimum(level.low, before), level.low)
    at = np.flatnonzero(head)
    out.name[at] = mix(mix(level.name[at] * _ODD) + level.name[at + 1] + np.uint64(seed))
    out.end[at] = level.end[at + 1]
    out.low[at] = np.minimum(level.low[at], level.low[at + 1])
    out.high[at] = np.maximum(level.high[at], level.high[at + 1])
    return out.take(~tail), head[~tail]


def candidates(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(name, begin, end, low, high) of every symbol that may stand for a window."""
    place = np.arange(len(hashes))
    level = Level(mix(hashes), place, place + 1, place, place + 1, rows)
    made = [level]
    level, fresh = compress_runs(level)
    made.append(level.take(fresh))
    for seed in range(1, ROUNDS + 1):
        level, fresh = compress_pairs(level, seed)
        made.append(level.take(fresh))
    name, begin, end, low, high = (
        np.concatenate([getattr(part, field) for part in made])
        for field in ("name", "begin", "end", "low", "high")
    )
    fits = high - low <= width
    return name[fits], begin[fits], end[fits], low[fits], high[fits]


def representatives(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one symbol: (name, first word of first window, of last window, symbol's begin, row)."""
    rows = row_of(bounds)
    count = len(hashes)
    name, begin, end, low, high = candidates(hashes, rows, width)
    if len(name) >= 1 << _PLACE:
        raise ValueError("a text has more words than a selection key can number")
    rank = np.uint64(7) - np.minimum(end - begin, 4).astype(np.uint64)
    key = (rank << np.uint64(61)) | (mix(name + np.uint64(77)) >> np.uint64(29) << np.uint64(_PLACE))
    key |= np.arange(len(name), dtype=np.uint64)
    # The windows that hold a stretch begin from high - width to low: a range minimum,
    # spread as two overlapping powers of two and pushed down by halves.
    begins, length = high - width + width, low - (high - width) + 1  # shifted to be positive
    worst = np.uint64((1 << 64) - 1)
    best = np.full(count + 2 * width, worst)
    power = 1 << (width.bit_length() - 1)
    while power:
        fits = (length >= power) & (length < 2 * power)
        np.minimum.at(best, begins[fits], key[fits])
        np.minimum.at(best, begins[fits] + length[fits] - power, key[fits])
        power //= 2
        if power:
            spread = best.copy()
            np.minimum(spread[power:], best[:-power], out=spread[power:])
            best = spread
    start = np.arange(count)
    valid = start + width <= bounds[rows + 1]
    start, chosen = start[valid], (best[width : width + count][valid] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    if not len(start):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    symbol = chosen[at]
    return name[symbol], start[at], start[last], begin[symbol], rows[start[at]]


class Prefix:
    """Hashes of stretches of words from running sums."""

    def __init__(self) -> None:
        self.base = 0x9FB21C651E98DF25
        self.powers = self.inverses = np.ones(1, np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        need = len(hashes) + 1
        if len(self.powers) < need:
            for field, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                table = np.full(2 * need, base, np.uint64)
                table[0] = 1
                setattr(self, field, np.multiply.accumulate(table))
        out = np.zeros(need, np.uint64)
        np.cumsum(mix(hashes) * self.powers[: need - 1], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[begin]) * self.inverses[begin])


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def symbol_rows(docs: DataFrame, width: int) -> DataFrame:
    """(name, whole, doc_id, body, span): a symbol, a hash of what its windows cover, their first words.

    ``span`` holds the first and the last window's first word, 32 bits each.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, prefix = Splitter(lower=False), Prefix()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bodies = batch.column(2).to_numpy()
            for first, _, data, offsets in stretches(batch.column(1)):
                words = splitter.split(data, offsets)
                name, start, last, begin, row = representatives(words.hashes, words.bounds, width)
                sums = prefix.sums(words.hashes)
                whole = prefix.stretch(sums, start, last + width)
                shape = ((last - start) << 20) + (begin - start)
                whole = mix(whole + mix(shape.astype(np.uint64)))
                base = words.bounds[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(name),
                        _long(whole),
                        pa.array(ids[first + row], pa.int64()),
                        pa.array(bodies[first + row], pa.int64()),
                        pa.array(((start - base) << 32) | (last - base)),
                    ],
                    names=["name", "whole", "doc_id", "body", "span"],
                )

    return in_batches(docs).mapInArrow(
        emit, "name bigint, whole bigint, doc_id bigint, body bigint, span bigint"
    )


def window_rows(docs: DataFrame, width: int) -> DataFrame:
    """(window, doc_id, body, start, late) for the windows in the ``spans`` of each document.

    Of equal windows in a batch only the first competes with other batches. The
    rest are late for certain; they get names of their own, so that a very
    common window is not one long stream.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, prefix = Splitter(lower=False), Prefix()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bodies, lists = batch.column(2).to_numpy(), batch.column(3)
            names, docs_of, bodies_of, places = [], [], [], []
            for first, after, data, offsets in stretches(batch.column(1)):
                words = splitter.split(data, offsets)
                sums = prefix.sums(words.hashes)
                starts, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for row in range(first, after):
                    base, limit = words.bounds[row - first], words.bounds[row - first + 1]
                    mask = _covered(lists[row].values.to_numpy(), limit - base, 1)
                    starts.append(np.flatnonzero(mask) + base)
                    owners.append(np.full(len(starts[-1]), row))
                start, owner = np.concatenate(starts), np.concatenate(owners)
                fits = start + width <= words.bounds[owner - first + 1]
                start, owner = start[fits], owner[fits]
                names.append(prefix.stretch(sums, start, start + width))
                docs_of.append(ids[owner].astype(np.int64))
                bodies_of.append(bodies[owner])
                places.append(start - words.bounds[owner - first])
            name, doc, body, place = (np.concatenate(x) for x in (names, docs_of, bodies_of, places))
            order = np.lexsort((place, body, doc, name))
            name, doc, body, place = (x[order] for x in (name, doc, body, place))
            # A repeated row is the same window, not a later one.
            same = np.append(False, name[1:] == name[:-1])[: len(name)]
            other = (doc[1:] != doc[:-1]) | (body[1:] != body[:-1]) | (place[1:] != place[:-1])
            moved = np.append(False, other)[: len(name)]
            group = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
            late = np.cumsum(moved & same) > np.cumsum(moved & same)[group]
            owner = doc[late].astype(np.uint64) * _ODD + mix(body[late].astype(np.uint64))
            name[late] = mix(owner + place[late].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [_long(name), pa.array(doc), pa.array(body), pa.array(place), pa.array(late)],
                names=["window", "doc_id", "body", "start", "late"],
            )

    return in_batches(docs).mapInArrow(
        emit, "window bigint, doc_id bigint, body bigint, start bigint, late boolean"
    )


def _covered(spans: np.ndarray, size: int, reach: int) -> np.ndarray:
    """Words from the first window's first word to ``reach - 1`` past the last window's."""
    change = np.zeros(size + 1, np.int32)
    begin = np.minimum(spans >> 32, size)
    end = np.minimum((spans & 0xFFFFFFFF) + reach, size)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, body, spans): runs of windows whose words also start earlier.

    ``docs`` has (doc_id, text, body) and every row of it is told apart by id and body.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    document = ["doc_id", "body"]
    symbol = Window.partitionBy("name")
    shared = materialise(
        symbol_rows(known, width)
        .withColumn("same", F.min("whole").over(symbol) == F.max("whole").over(symbol))
        .withColumn("n", F.count("*").over(symbol))
        .withColumn("turn", F.dense_rank().over(symbol.orderBy(*document, "span")))
        .filter("n > 1")
        .select(*document, "span", "same", "turn"),
        "shared",
    )
    later = shared.filter("same AND turn > 1").select(*document, "span")

    unsure = shared.filter("NOT same").groupBy(*document).agg(F.collect_list("span").alias("spans"))
    checked = known.join(unsure, document).select("doc_id", "text", "body", "spans")
    window = Window.partitionBy("window", "late").orderBy(*document, "start")
    single = (
        window_rows(checked, width)
        .withColumn("turn", F.dense_rank().over(window))
        .filter("late OR turn > 1")
        .select(*document, (F.col("start") * (1 << 32) + F.col("start")).alias("span"))
    )
    return later.unionByName(single).groupBy(*document).agg(F.collect_list("span").alias("spans"))


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: its words less those of repeated windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(lower=False)
        for batch in batches:
            lists = batch.column(2)
            for first, after, data, offsets in stretches(batch.column(1)):
                words = splitter.split(data, offsets)
                sizes, removed, kept = [], [], []
                for row in range(first, after):
                    begin, end = words.bounds[row - first], words.bounds[row - first + 1]
                    spans = lists[row].values
                    keep = np.ones(end - begin, bool)
                    if spans is not None and len(spans):
                        keep = ~_covered(spans.to_numpy(), end - begin, width)
                    sizes.append(end - begin)
                    removed.append(int((~keep).sum()))
                    kept.append(_joined(words, np.flatnonzero(keep) + begin))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:after],
                        pa.array(sizes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    apart = told_apart(docs)
    return (
        in_batches(apart)
        .join(repeated_spans(apart, width), ["doc_id", "body"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    )


def _joined(words, numbers: np.ndarray) -> bytes:
    """The given words with one space between them."""
    if not len(numbers):
        return b""
    starts, lengths = words.starts[numbers], words.ends[numbers] - words.starts[numbers]
    ends = np.cumsum(lengths + 1)
    out = np.full(ends[-1], 0x20, np.uint8)
    source = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
    target = np.repeat(np.append(0, ends[:-1]) - np.append(0, np.cumsum(lengths)[:-1]), lengths)
    out[target + np.arange(lengths.sum())] = words.data[source]
    return out[:-1].tobytes()


def removal_digest(docs: DataFrame, width: int = 20) -> DataFrame:
    """The sizes and a hash of what is kept of each document."""
    return without_repeats(docs, width).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def oracle(width: int = 20) -> str:
    """Every window compared with every other, as SQL for the checking engine."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, hash({run}) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width} + 2)) AS i FROM cut WHERE len(w) >= {width})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n
         FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS i FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM cut),
kept AS (SELECT doc_id, count(g.i) AS removed, string_agg(x, ' ' ORDER BY i) FILTER (g.i IS NULL) AS t
         FROM word LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT c.doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM cut c LEFT JOIN kept USING (doc_id)
"""
