"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a rest, the rest into equal
pieces of at most an eighth of a window; each piece lies in one sequence. Whole windows are full
as they are. The other pieces are dealt by hash into groups of a fixed number of
tokens, and each group is split among its windows by differencing: every piece
is a partial partition with one filled window, and the two partitions of largest
imbalance merge again and again, fullest window to emptiest, until one is left.
That gives windows of nearly equal loads. When the fullest exceeds the capacity,
the group is split among one window more.

A piece's group follows its place in a written table of pieces, so repeated rows
spread like any others, and the number of groups follows the tokens.

Defined results: null and empty texts consist of the end id alone; repeated rows
and rows with a null id are packed each for themselves; an empty table gives no
rows; columns besides the id and the text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.arrays import find
from ledgerloom.llm.words import Splitter, in_batches, non_letter_bytes, stretches
from ledgerloom.session import materialise

END_WORD = np.uint64(0x5851F42D4C957F2D)
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
KNOWN_UNITS = 400_000
PARTS = 8  # a piece of a rest is at most this share of a window


class WordIds:
    """Ids of units of text, remembered for those seen last.

    The tokenizer folds case, drops white space, and looks at runs of letters by
    themselves. So words are cut where letters meet other signs, lower-cased, and
    every distinct unit is encoded once by the tokenizer itself. Words with an
    apostrophe, a bar or signs beyond Latin letters stay whole, since contractions,
    special tokens and other scripts need their neighbours. The memory starts
    afresh when it is full.
    """

    def __init__(self, model: str, end_id: int) -> None:
        self.tokenizer, self.end_id = Tokenizer.from_str(model), end_id
        self.splitter = Splitter(lower=False)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letter = ~non_letter_bytes()
        self.whole = np.zeros(256, bool)  # bytes that keep a word whole
        self.whole[[ord("'"), ord("|"), 0xC2, *range(0xC4, 0x100)]] = True
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[ord("A") : ord("Z") + 1] += 32
        self._forget()

    def _forget(self) -> None:
        self.known = np.array([END_WORD])  # hashes in order, and the number of each
        self.number = np.zeros(1, np.int64)
        self.begin, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.full(1, self.end_id, np.uint32)

    def _store(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        number = np.arange(len(keys)) + len(self.begin)
        order = np.argsort(np.concatenate([self.known, keys]), kind="stable")
        self.known = np.concatenate([self.known, keys])[order]
        self.number = np.concatenate([self.number, number])[order]
        self.begin = np.concatenate([self.begin, np.cumsum(sizes) - sizes + len(self.ids)])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self, keys: np.ndarray, units: list[str], letters: np.ndarray) -> None:
        """Encode new units. Runs of letters go as one text, in which the last id of each is known by its end mark."""
        plain, odd = np.flatnonzero(letters), np.flatnonzero(~letters)
        if len(plain):
            joined = [" ".join([units[i] for i in plain[at : at + 512].tolist()]) for at in range(0, len(plain), 512)]
            found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.concatenate([np.array(encoding.ids, np.uint32) for encoding in found])
            ends = np.flatnonzero(self.final[ids])
            self._store(keys[plain], ids, np.diff(ends, prepend=-1))
        if len(odd):
            found = self.tokenizer.encode_batch_fast([units[i] for i in odd.tolist()], add_special_tokens=False)
            lists = [encoding.ids for encoding in found]
            flat = np.array([x for ids in lists for x in ids], np.uint32)
            self._store(keys[odd], flat, np.array([len(ids) for ids in lists]))

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bytes, starts, ends, hashes, bounds, runs of letters) of the units of texts."""
        words = self.splitter.split(data, offsets)
        stays = self.whole[data]
        stays[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
        sums = np.append(0, np.cumsum(stays))
        kept = sums[words.ends] > sums[words.starts]
        letter = self.letter[data]
        space = self.splitter.separator[data]
        turn = np.flatnonzero((letter[1:] != letter[:-1]) & ~space[1:] & ~space[:-1]) + 1
        owner = np.searchsorted(words.starts, turn, side="right") - 1
        turn = turn[~kept[owner] & (turn != words.starts[owner])]
        folded = self.fold[data]
        for start, end in zip(words.starts[kept], words.ends[kept]):
            folded[start:end] = data[start:end]
        starts = np.sort(np.concatenate([words.starts, turn]))
        ends = np.sort(np.concatenate([words.ends, turn]))
        self.splitter.load(folded)
        letters = self.letter[folded[starts]]
        letters[np.searchsorted(starts, words.starts[kept])] = False
        return folded, starts, ends, self.splitter.stretch(starts, ends), np.searchsorted(starts, offsets), letters

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts, each with the end id."""
        folded, starts, ends, own, bounds, letters = self.units(data, offsets)
        hashes = np.insert(own, bounds[1:], END_WORD)
        bounds = bounds + np.arange(len(bounds))
        distinct, first, inverse = np.unique(own, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > KNOWN_UNITS:
            self._forget()
        new = np.flatnonzero(find(self.known, distinct) < 0)
        if len(new):
            raw = folded.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            self._learn(distinct[new], [raw[low:high].decode() for low, high in spans], letters[first[new]])
        place = np.zeros(len(hashes), np.int64)
        place[hashes != END_WORD] = self.number[find(self.known, distinct)][inverse]
        begin, size = self.begin[place], self.size[place]
        last = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (last - size), size) + np.arange(last[-1] if len(last) else 0)]
        return ids, np.append(0, last)[bounds]


def cuts(total: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin, and its end: whole windows, then equal parts of the rest.

    Small parts of many different sizes are what differencing balances best.
    """
    whole = total // capacity * capacity
    rest = total - whole
    parts = -(-rest // max(1, capacity // PARTS))
    return [*range(0, whole, capacity), *(whole + rest * i // parts for i in range(parts)), total]


def pieces(docs: DataFrame, model: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document, with the ids themselves if wanted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(model, end_id)
        for batch in batches:
            for first, _, data, offsets in stretches(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                rows, starts, lengths, sums, totals, parts = [], [], [], [], [], []
                for row, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    marks = cuts(end - begin, capacity)
                    for low, high in zip(marks[:-1], marks[1:]):
                        piece = ids[begin + low : begin + high].astype("<u4")
                        rows.append(first + row)
                        starts.append(low)
                        lengths.append(high - low)
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(end - begin)
                        if with_ids:
                            parts.append(piece.astype(np.int32))
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)],
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return in_batches(docs).select("doc_id", "text").mapInArrow(cut, schema)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece by multiway differencing, with windows of nearly equal sums.

    A partial partition holds its filled windows only, by falling sums, so all of
    them together never hold more numbers than there are pieces. Single pieces
    wait in falling order and need no partition until they merge.
    """
    order = np.argsort(-sizes, kind="stable")
    parent = np.arange(2 * len(sizes))
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    waiting = 0
    used = turn = len(sizes)

    def widest() -> tuple[np.ndarray, np.ndarray]:
        """Sums and nodes of the partition of largest difference; pieces before partitions."""
        nonlocal waiting
        if waiting < len(order):
            item = order[waiting]
            if not heap or (sizes[item] if windows > 1 else 0) >= -heap[0][0]:
                waiting += 1
                return sizes[item : item + 1].astype(np.int64), np.array([item])
        return heapq.heappop(heap)[2:]

    for _ in range(len(sizes) - 1):
        (sums, nodes), (others, their) = widest(), widest()
        # The largest sums of one lie on the smallest of the other, most of them empty.
        others, their = others[::-1], their[::-1]
        both = max(0, len(sums) + len(others) - windows)
        alone = len(sums) - both
        fresh = np.arange(used, used + both)
        parent[nodes[alone:]] = parent[their[:both]] = fresh
        used += both
        sums = np.concatenate([sums[:alone], sums[alone:] + others[:both], others[both:]])
        nodes = np.concatenate([nodes[:alone], fresh, their[both:]])
        falling = np.argsort(-sums, kind="stable")
        sums, nodes = sums[falling], nodes[falling]
        turn += 1
        least = int(sums[-1]) if len(sums) == windows else 0
        heapq.heappush(heap, (least - int(sums[0]), turn, sums, nodes))
    window = np.full(2 * len(sizes), -1)
    _, roots = widest()
    window[roots] = np.arange(len(roots))
    at = np.arange(len(sizes))
    while (parent[at] != at).any():
        at = parent[at]
    return window[at]


def windows_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece of a group; every window holds at most ``capacity``."""
    out = np.zeros(len(lengths), np.int64)
    full = lengths == capacity
    out[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    if not len(rest):
        return out
    # Windows filled to the last few tokens are beyond reach, so the count begins with a little room.
    count = max(1, -(-int(lengths[rest].sum() * 1.0005) // capacity))
    while True:
        window = difference(lengths[rest], count)
        if np.bincount(window, lengths[rest]).max() <= capacity:
            break
        count += 1
    _, window = np.unique(window, return_inverse=True)
    out[rest] = full.sum() + window
    return out


def packed(parts: DataFrame, capacity: int = 4096, group_windows: int = 512) -> DataFrame:
    """The pieces with ``sequence_id`` and their ``offset`` in it."""
    parts = materialise(parts, "pieces")
    total = parts.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-total // (capacity * group_windows)))
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    columns = parts.columns

    def pack(group: pa.Table) -> pa.Table:
        doc, start, row, length = (
            group.column(name).fill_null(-1).to_numpy() for name in ("doc_id", "start", "row", "length")
        )
        order = np.lexsort((row, start, doc))
        length = length[order]
        sequence = group.column("group")[0].as_py() * (1 << 20) + windows_of(length, capacity)
        along = np.argsort(sequence, kind="stable")
        before = np.cumsum(length[along]) - length[along]
        first = np.flatnonzero(np.diff(sequence[along], prepend=-1))
        offset = np.zeros(len(length), np.int64)
        offset[along] = before - np.repeat(before[first], np.diff(first, append=len(length)))
        out = group.select(columns).take(pa.array(order))
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return (
        parts.select("*", F.pmod(place, F.lit(groups)).alias("group"), place.alias("row"))
        .groupBy("group")
        .applyInArrow(pack, f"{types}, sequence_id bigint, offset bigint")
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each.

    The tokenizer file is read once here and travels with the tasks.
    """
    model = Tokenizer.from_file(tokenizer_path).to_str()
    return packed(pieces(docs, model, capacity, end_id, with_ids), capacity)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed windows themselves, of at most the capacity each."""
    part = F.struct("offset", "ids")
    return pieces_with_ids.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["ids"])).alias("ids")
    )
