"""Words of many texts at once, as arrays: where they lie and a 64-bit hash of each.

Used inside Python workers on Arrow batches. A batch is taken in stretches of
about a mebibyte, so memory does not follow the batch; a longer text is a
stretch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

# The separators of words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def in_batches(texts: DataFrame, rows: int = 1000) -> DataFrame:
    """The same table, which goes to Python in Arrow batches of fewer rows.

    The default of ten thousand texts holds too much at once. A session with a
    setting of its own keeps it.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = texts.sparkSession.conf
    if conf.get(setting) == "10000":
        conf.set(setting, str(rows))
    return texts


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def space_bytes() -> np.ndarray:
    """True for the bytes that separate words."""
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


def non_letter_bytes() -> np.ndarray:
    """True for every byte but ASCII letters and the bytes of longer characters."""
    table = np.ones(256, bool)
    table[ord("a") : ord("z") + 1] = False
    table[ord("A") : ord("Z") + 1] = False
    table[128:] = False
    return table


@dataclass
class Words:
    """Words of a run of texts; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


class Splitter:
    """Splits and hashes words; keeps the powers that the hash needs."""

    def __init__(self, lower: bool, separators: np.ndarray | None = None) -> None:
        self.separator = space_bytes() if separators is None else separators
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[ord("A") : ord("Z") + 1] += 32
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reserve(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, STRETCH + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("powers", _BASE), ("inverses", inverse)):
                table = np.full(size, base & _MASK, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def split(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """``data`` are the bytes of all texts, ``offsets`` where each begins and the last ends."""
        size = len(data)
        self._reserve(size + 1)
        data = self.fold[data]
        inside = ~self.separator[data]
        first = np.empty(size + 1, bool)
        first[1:size] = inside[1:] & ~inside[:-1]
        first[0] = size > 0 and inside[0]
        first[size] = False
        begins = offsets[:-1][offsets[:-1] < size]
        first[begins] |= inside[begins]
        starts = np.flatnonzero(first)
        last = np.zeros(size + 1, bool)
        last[1:size] = inside[:-1] & ~inside[1:]
        if size:
            last[size] = inside[-1]
        inner = offsets[(offsets > 0) & (offsets < size)]
        last[inner] |= inside[inner - 1]
        ends = np.flatnonzero(last)
        self.load(data)
        hashes = self.stretch(starts, ends)
        return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))

    def load(self, data: np.ndarray) -> None:
        """Take the bytes whose stretches are hashed next."""
        self._reserve(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=self.sums[1:])

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of the bytes taken last."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts])


def stretches(texts: pa.Array, limit: int = STRETCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first row, row after the last, bytes, offsets); null counts as empty."""
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        after = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        after = min(max(after, row + 1), len(texts))
        yield row, after, data[ends[row] : ends[after]], ends[row : after + 1] - ends[row]
        row = after


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each word the text it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every run of ``width`` words inside one text."""
    rows = row_of(words.bounds)
    first = np.arange(len(rows))
    keep = first + width <= words.bounds[rows + 1]
    return first[keep], rows[keep]


def sequence_hash(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    total = np.full(len(first), (seed * _BASE + int(width)) & _MASK, np.uint64)
    for i in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[first + i]
    return mix(total)
