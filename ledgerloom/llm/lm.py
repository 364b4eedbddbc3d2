"""A bigram language model with interpolated modified Kneser-Ney smoothing.

Three passes over the texts. The first counts words: every task sends one block
of sorted hashes and counts to each range of hashes, and each range becomes a
sorted file, so a word's number is its rank. The second counts pairs of numbers
in the same way, in ranges of contexts, and sums up for every word how many
contexts it follows. The third maps those files into memory and scores texts by
binary search. What a task holds is one block or one range; the number of ranges
follows ``spark.sql.shuffle.partitions``. The driver sees a few counts per range.

Tokens are the lower-cased words of a text and one end token. Pairs begin with a
start symbol that is no token. Discounts follow Chen and Goodman (1999), for the
pairs from their counts and for the words from their context counts; what the
words leave goes to every known word and the unknown one in equal parts.

Defined results: a null text counts as empty and consists of its end token; a row
with a null id is trained on; repeated rows count each time; without training
rows every word is unknown and both scores are those of a uniform guess;
an empty table gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrays import Arrays, find, mapped_folder, save
from ledgerloom.llm.words import Splitter, in_batches, mix, stretches
from ledgerloom.session import materialise

END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
BLOCK = 1 << 22  # pairs a task gathers before it sends blocks
BLOCKS = "part int, payload binary"
SCORES = (
    "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
)


def tokens_of(splitter: Splitter, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds): the words of each text and its end token."""
    for first, _, data, offsets in stretches(texts):
        words = splitter.split(data, offsets)
        yield first, np.insert(words.hashes, words.bounds[1:], END), words.bounds + np.arange(len(words.bounds))


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash: equal shares of the hash space, in hash order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance, which compresses blocks of neighbouring numbers well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    body = _planes(steps) + _planes(counts.astype(np.uint32))
    return len(keys).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(payload[:8], "little")
    body = np.frombuffer(pa.decompress(payload[8:], 12 * size, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(body[: 8 * size].reshape(8, size).T).view(np.uint64).ravel()
    counts = np.ascontiguousarray(body[8 * size :].reshape(4, size).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _blocks(keys: np.ndarray, counts: np.ndarray, parts: np.ndarray, count: int) -> pa.RecordBatch:
    """One packed row for each part; keys are sorted within a part."""
    order = np.argsort(parts, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.searchsorted(parts[order], np.arange(count + 1))
    full = [p for p in range(count) if cuts[p] < cuts[p + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array([_pack(keys[cuts[p] : cuts[p + 1]], counts[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()),
        ],
        names=["part", "payload"],
    )


def _merged(payloads: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    pieces = [_unpack(payload.as_py()) for payload in payloads]
    return _summed(np.concatenate([k for k, _ in pieces]), np.concatenate([c for _, c in pieces]))


class Vocabulary:
    """Numbers of words: the rank of a hash among all hashes of the training tokens."""

    def __init__(self, folder: str, starts: list[int]) -> None:
        self.arrays, self.starts = Arrays(folder), starts
        self.size, self.parts = starts[-1], len(starts) - 1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for unknown words. ``hashes`` are sorted."""
        out = np.full(len(hashes), -1)
        cuts = np.searchsorted(_parts(hashes, self.parts), np.arange(self.parts + 1))
        for part in range(self.parts):
            begin, end = cuts[part], cuts[part + 1]
            if begin < end and self.starts[part] < self.starts[part + 1]:
                found = find(self.arrays[f"word-{part}"], hashes[begin:end])
                out[begin:end] = np.where(found >= 0, found + self.starts[part], -1)
        return out

    def values(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Entries of an array that is cut like the vocabulary; zero for unknown words."""
        out = np.zeros(len(numbers))
        part = np.searchsorted(self.starts, numbers, side="right") - 1
        for p in np.unique(part[numbers >= 0]):
            mine = (part == p) & (numbers >= 0)
            out[mine] = self.arrays[f"{name}-{p}"][numbers[mine] - self.starts[p]]
        return out


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts one, two, and three or more; plain halves where a count class is missing."""
    if min(n) <= 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(value, 0.0), count - 1e-9) for count, value in zip((1, 2, 3), raw)]


class Model:
    """What workers need to score: the folder, the cuts of the vocabulary, totals and discounts."""

    def __init__(self, folder: str, starts: list[int], tokens: int) -> None:
        self.folder, self.starts, self.tokens = folder, starts, tokens
        self.parts = len(starts) - 1
        self.pairs = 0
        self.pair_discounts = self.word_discounts = [0.5, 0.5, 0.5]
        self.word_left = 1.0

    def kept(self, counts: np.ndarray, discounts: list[float]) -> np.ndarray:
        less = np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]
        return np.maximum(counts - less, 0.0)


def count_words(train: DataFrame, folder: str, parts: int) -> Model:
    """Sorted word hashes and counts as files, one pair for each range of hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(lower=True)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return _blocks(keys, counts, _parts(keys, parts), parts)

        for batch in batches:
            for _, hashes, _ in tokens_of(splitter, batch.column(0)):
                held.append(np.unique(hashes, return_counts=True))
                size += len(held[-1][0])
                if size > BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = _merged(table.column("payload"))
        save(folder, f"word-{part}", keys)
        save(folder, f"count-{part}", counts)
        return pa.table({"part": pa.array([part], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())]})

    sizes = (
        in_batches(train).select("text")
        .mapInArrow(emit, BLOCKS)
        .groupBy("part")
        .applyInArrow(merge, "part int, words bigint, tokens bigint")
        .collect()  # one row for each range
    )
    words = {row["part"]: row["words"] for row in sizes}
    starts = np.cumsum([0, *(words.get(part, 0) for part in range(parts))]).tolist()
    return Model(folder, starts, sum(row["tokens"] for row in sizes))


def _keys(numbers: np.ndarray, bounds: np.ndarray, start: int, unknown: int) -> np.ndarray:
    """Context and word of every token in one number; a text begins with the start symbol."""
    numbers = np.where(numbers < 0, unknown, numbers).astype(np.uint64)
    context = np.empty(len(numbers), np.uint64)
    context[1:] = numbers[:-1]
    context[bounds[:-1]] = start
    return context << np.uint64(32) | numbers


def _context_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return _parts(mix(keys >> np.uint64(32)), parts)


def _flags(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def count_pairs(train: DataFrame, model: Model) -> Model:
    """Sorted pairs with counts, sums per context, and context counts per word, as files."""
    folder, starts, parts = model.folder, model.starts, model.parts
    start = starts[-1]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, vocabulary = Splitter(lower=True), Vocabulary(folder, starts)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _blocks(keys, counts, _context_part(keys, parts), parts)

        for batch in batches:
            for _, hashes, bounds in tokens_of(splitter, batch.column(0)):
                distinct, place = np.unique(hashes, return_inverse=True)
                held.append(_keys(vocabulary.numbers(distinct)[place], bounds, start, start + 1))
                size += len(hashes)
                if size > BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = _merged(table.column("payload"))
        large = np.flatnonzero(counts >= 255)
        save(folder, f"pair-{part}", keys)
        save(folder, f"pair_count-{part}", np.minimum(counts, 255).astype(np.uint8))
        save(folder, f"large-{part}", large)
        save(folder, f"large_count-{part}", counts[large])
        context = keys >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]
        save(folder, f"context-{part}", context[at])
        save(folder, f"context_sums-{part}", np.stack(sums, axis=1))
        words, follows = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        owner = np.searchsorted(starts, words, side="right") - 1
        batch = _blocks(words, follows, owner, parts)
        rows = pa.table({"part": batch.column(0), "payload": batch.column(1)})
        flags = pa.array([_flags(counts)] + [None] * (rows.num_rows - 1), pa.list_(pa.int64()))
        return rows.append_column("flags", flags)

    sent = materialise(
        train.select("text").mapInArrow(emit, BLOCKS).groupBy("part").applyInArrow(merge, f"{BLOCKS}, flags array<bigint>"),
        "contexts",
    )

    def gather(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        words, follows = _merged(table.column("payload"))
        dense = np.zeros(starts[part + 1] - starts[part], np.int64)
        dense[words.astype(np.int64) - starts[part]] = follows
        save(folder, f"follows-{part}", dense)
        flags = _flags(dense) + [int((dense > 2).sum()), int(dense.sum())]
        return pa.table({"flags": pa.array([flags], pa.list_(pa.int64()))})

    def total(frame: DataFrame, size: int) -> list[int]:
        row = frame.agg(*[F.coalesce(F.sum(F.col("flags")[i]), F.lit(0)) for i in range(size)]).first()
        return list(row)

    words = materialise(
        sent.select("part", "payload").groupBy("part").applyInArrow(gather, "flags array<bigint>"), "follows"
    )
    *word_flags, more, model.pairs = total(words, 6)
    model.pair_discounts = _discounts(total(sent, 4))
    model.word_discounts = _discounts(word_flags)
    if model.pairs:
        left = np.dot(model.word_discounts, [word_flags[0], word_flags[1], more])
        model.word_left = float(left) / model.pairs
    return model


class Scorer:
    """Log probabilities of tokens by the mapped model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.vocabulary = Vocabulary(model.folder, model.starts)
        self.arrays = self.vocabulary.arrays

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """Probability of words without context."""
        model = self.model
        rest = model.word_left / (model.starts[-1] + 1)
        if not model.pairs:
            return np.full(len(numbers), rest)
        follows = self.vocabulary.values("follows", numbers)
        return model.kept(follows, model.word_discounts) / model.pairs + rest

    def pairs(self, keys: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of each distinct sorted pair, given its word's own probability."""
        out = word.copy()
        part = _context_part(keys, self.model.parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.model.parts + 1))
        for p in np.unique(part):
            mine = order[cuts[p] : cuts[p + 1]]
            if self.model.pairs and self._exists(p):
                out[mine] = self._in_part(p, keys[mine], word[mine])
        return out

    def _exists(self, part: int) -> bool:
        try:
            return len(self.arrays[f"pair-{part}"]) > 0
        except FileNotFoundError:  # a range without any context
            return False

    def _in_part(self, part: int, keys: np.ndarray, word: np.ndarray) -> np.ndarray:
        contexts = self.arrays[f"context-{part}"]
        row = find(contexts, keys >> np.uint64(32))
        seen = row >= 0
        sums = self.arrays[f"context_sums-{part}"][np.maximum(row, 0)].astype(float)
        at = find(self.arrays[f"pair-{part}"], keys)
        counts = np.where(at >= 0, self.arrays[f"pair_count-{part}"][np.maximum(at, 0)], 0).astype(float)
        large = find(self.arrays[f"large-{part}"], at)
        many = large >= 0
        counts[many] = self.arrays[f"large_count-{part}"][large[many]]
        kept = self.model.kept(counts, self.model.pair_discounts)
        left = sums[:, 1:] @ np.array(self.model.pair_discounts)
        return np.where(seen, (kept + left * word) / np.maximum(sums[:, 0], 1), word)


def train_model(train: DataFrame, parts: int | None = None) -> Model:
    """Count the texts of ``train`` and return the model over its files."""
    spark = train.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = mapped_folder(spark, "lm")
    return count_pairs(train, count_words(train, folder, parts))


def score_texts(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """The carried columns with n_tokens, n_known, train_tokens, base_score, score and perplexity."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, scorer = Splitter(lower=True), Scorer(model)
        size, start = model.starts[-1], model.starts[-1]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, hashes, bounds in tokens_of(splitter, texts):
                distinct, place = np.unique(hashes, return_inverse=True)
                number = scorer.vocabulary.numbers(distinct)
                count = scorer.vocabulary.values("count", number)
                base = np.log10((count + 1) / (model.tokens + size + 1))
                alone = scorer.words(number)
                keys = _keys(number[place], bounds, start, start + 1)
                pair, pair_at, pair_place = np.unique(keys, return_index=True, return_inverse=True)
                chance = np.log10(scorer.pairs(pair, alone[place[pair_at]]))
                sums = [
                    np.add.reduceat(values, bounds[:-1])
                    for values in ((number >= 0)[place].astype(np.int64), base[place], chance[pair_place])
                ]
                tokens = np.diff(bounds)
                rows = slice(first, first + len(tokens))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i)[rows] for i in range(batch.num_columns - 1)],
                        pa.array(tokens, pa.int64()),
                        pa.array(sums[0], pa.int64()),
                        pa.array(np.full(len(tokens), model.tokens), pa.int64()),
                        pa.array(sums[1]),
                        pa.array(sums[2]),
                        pa.array(10 ** (-sums[2] / tokens)),
                    ],
                    names=names,
                )

    kept = docs.select(*carried, F.col("text").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    names = [*carried, *(field.split()[0] for field in SCORES.split(", "))]
    return in_batches(kept).mapInArrow(score, f"{types}, {SCORES}")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether a row is kept from training, by the checksum of its id as text."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def corpus_scores(docs: DataFrame) -> DataFrame:
    """Scores of every document by a model of six sevenths of them."""
    marked = docs.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    model = train_model(marked.filter(~F.col("held_out")))
    return score_texts(marked, model, ["doc_id", "held_out"])
