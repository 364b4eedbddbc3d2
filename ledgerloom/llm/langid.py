"""Language identification by the nearest of several centroids per language.

A text becomes a vector of its letter n-grams (one to three letters, word borders
counted as a letter), hashed to a fixed number of dimensions, weighted by log
frequency and inverse document frequency, and brought to length one. Each
language has a few centroids: spherical k-means over a bounded sample of its
training texts, one task per language. A text gets the language of the centroid
of highest cosine; it is marked as rejected when it lies farther from that
centroid than almost all training texts of the language do from theirs.

Document frequencies are counted over all training texts. The sample bound is
``SAMPLE`` texts per language, drawn by id.

Defined results: null texts and texts without a letter are ``und`` with score 0;
rows without a language teach nothing; repeated rows count each time in training
and are predicted alike; without training rows every text is ``und``; an empty
table gives no rows. Columns besides the id, the text and, for training, the
language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import in_batches

DIMENSIONS = 4096
SAMPLE = 2000
CENTROIDS = 3
REJECTED_SHARE = 0.005
UNKNOWN = "und"
CHARACTERS = 1 << 18  # letters of a stretch of texts that is turned to vectors at once


class Grams:
    """Counts of hashed n-grams of letters."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.letter = np.array([chr(c).isalpha() for c in range(0x110000)])

    def runs(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, after, counts): stretches of texts with a row of gram counts each."""
        first = 0
        while first < len(texts):
            after, size = first, 0
            while after < len(texts) and (after == first or size + len(texts[after]) <= CHARACTERS) and after - first < 256:
                size += len(texts[after])
                after += 1
            yield first, after, self.counts(texts[first:after])
            first = after

    def counts(self, texts: list[str]) -> np.ndarray:
        lowered = [text.lower() for text in texts]
        points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(text) + 1 for text in lowered])
        row = np.zeros(len(points), np.int64)
        row[1 : 1 + sizes.sum()] = np.repeat(np.arange(len(texts)), sizes)
        letters = np.where(self.letter[points], points, 0)
        kept = (letters > 0) | np.append(True, letters[:-1] > 0)  # runs of other characters are one border
        letters, row = letters[kept].astype(np.uint64), row[kept]
        total = np.zeros(len(texts) * self.dimensions, np.int64)
        value = np.zeros(len(letters), np.uint64)
        for length in (1, 2, 3):
            end = len(letters) - length + 1
            if end <= 0:
                break
            value = value[:end] * np.uint64(0x9E3779B97F4A7C15) + letters[length - 1 :] + np.uint64(length)
            used = letters[:end] > 0 if length == 1 else (row[:end] == row[length - 1 :]) | (letters[length - 1 :] == 0)
            code = (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
            slot = (code % np.uint64(self.dimensions)).astype(np.int64) + row[:end] * self.dimensions
            total += np.bincount(slot[used], minlength=len(total))
        return total.reshape(len(texts), self.dimensions)

    def has_letter(self, text: str | None) -> bool:
        return text is not None and any(map(str.isalpha, text))


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    """Languages with several centroids each, and the cosine below which a text is rejected."""

    idf: np.ndarray
    languages: list[str]
    vectors: np.ndarray  # one row per centroid
    owners: np.ndarray  # the language of each centroid
    floors: np.ndarray  # per language


def inverse_frequencies(train: DataFrame, dimensions: int) -> np.ndarray:
    """Smoothed inverse document frequency of each dimension over all texts of ``train``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dimensions)
        present = np.zeros(dimensions + 1, np.int64)
        for batch in batches:
            texts = [text or "" for text in batch.column(0).to_pylist()]
            for _, _, counts in grams.runs(texts):
                present[:-1] += (counts > 0).sum(axis=0)
            present[-1] += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dimensions + 1)), pa.array(present)], names=["dimension", "n"]
        )

    rows = (
        in_batches(train)
        .select("text")
        .mapInArrow(count, "dimension bigint, n bigint")
        .groupBy("dimension")
        .agg(F.sum("n").alias("n"))
        .collect()  # one row per dimension
    )
    found = np.zeros(dimensions + 1)
    for row in rows:
        found[row["dimension"]] = row["n"]
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 1


def spherical_means(vectors: np.ndarray, count: int, rounds: int = 15) -> np.ndarray:
    """Centroids of unit vectors by cosine, begun at spread-out points."""
    chosen = [vectors.mean(axis=0)]
    for _ in range(min(count, len(vectors))):
        nearest = (vectors @ np.stack(chosen).T).max(axis=1)
        chosen.append(vectors[int(nearest.argmin())])
    centres = np.stack(chosen[1:])
    for _ in range(rounds):
        owner = (vectors @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (owner == k).any():
                mean = vectors[owner == k].mean(axis=0)
                centres[k] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return centres


def fit_centroids(
    train: DataFrame,
    dimensions: int = DIMENSIONS,
    sample: int = SAMPLE,
    count: int = CENTROIDS,
    key: str = "doc_id",
) -> Centroids:
    """Learn from (key, text, lang); rows without a language or text teach nothing."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    idf = inverse_frequencies(train, dimensions)
    sizes = train.groupBy("lang").count()
    draw = F.crc32(F.concat(F.lit("fit:"), F.coalesce(F.col(key).cast("string"), F.lit("")))) / float(1 << 32)
    # One row per language, as the languages are the classes of the model.
    drawn = train.join(F.broadcast(sizes), "lang").filter(draw * F.col("count") < sample).select("lang", "text")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(dimensions)
        vectors = np.concatenate(
            [unit_vectors(counts, idf) for _, _, counts in grams.runs(rows["text"].tolist())]
        )
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        centres = spherical_means(vectors, count)
        floor = float(np.quantile((vectors @ centres.T).max(axis=1), REJECTED_SHARE))
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[0], "centroid": [c.tolist() for c in centres], "floor": floor}
        )

    fitted = drawn.groupBy("lang").applyInPandas(fit, "lang string, centroid array<float>, floor double")
    rows = sorted(fitted.collect(), key=lambda row: row["lang"])  # a few per language
    languages = sorted({row["lang"] for row in rows})
    floors = {row["lang"]: row["floor"] for row in rows}
    return Centroids(
        idf,
        languages,
        np.array([row["centroid"] for row in rows], np.float32).reshape(len(rows), dimensions),
        np.array([languages.index(row["lang"]) for row in rows], np.int64),
        np.array([floors[name] for name in languages]),
    )


def identify(docs: DataFrame, model: Centroids, carried: list[str]) -> DataFrame:
    """The carried columns with lang_pred, score (the cosine) and whether the text is rejected."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(model.idf))
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang = np.full(len(texts), len(model.languages))
            score = np.zeros(len(texts))
            plain = [text or "" for text in texts]
            if len(model.vectors):
                for first, after, counts in grams.runs(plain):
                    cosine = unit_vectors(counts, model.idf) @ model.vectors.T
                    best = cosine.argmax(axis=1)
                    score[first:after] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                    lang[first:after] = model.owners[best]
            blank = np.array([not grams.has_letter(text) for text in texts], bool)
            lang[blank], score[blank] = len(model.languages), 0.0
            floor = np.append(model.floors, 1.0)[lang]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(names[lang], pa.string()),
                    pa.array(score),
                    pa.array(score < floor),
                ],
                names=[*carried, "lang_pred", "score", "rejected"],
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    return in_batches(docs).select(*carried, F.col("text").alias("_text")).mapInArrow(
        predict, f"{types}, lang_pred string, score double, rejected boolean"
    )


def teaching_fold(key: Column) -> Column:
    """Whether a document may teach: its checksum modulo 5 is not 0."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(True))


def document_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    teaches = teaching_fold(F.col("doc_id"))
    model = fit_centroids(docs.filter(teaches).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", (~teaches).alias("held_out"), "text"), model, ["doc_id", "held_out"])
