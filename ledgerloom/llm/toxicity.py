"""Toxic passages as maximum-scoring segments of token log-odds.

A token is a run of letters, lower-cased; its features are the whole token and
its first five to eight bytes, so stems count in languages that compound. Each
feature has the log-odds of occurring in toxic against other documents under a
Dirichlet prior that follows overall use (Monroe and others, 2008). The most
significant features, a fixed number at most, form the lexicon; a token scores
its best feature, every other token a small penalty, chosen so that clean text
drifts down.

A linear-time scan (Ruzzo and Tompa, 1999) finds all maximal segments of a text.
Their scores are compared with what clean text of that length would give by
chance, an extreme-value distribution (Karlin and Altschul, 1990); the evidence
of a document is its best segment's surprise plus that of its further
significant ones. A logistic curve over binned evidence turns it into a
probability.

The fit reads a bounded sample of labelled rows, at most ``SAMPLE`` of each
label, drawn by id; scoring reads every text whole. The curve counts each sampled
row for as many rows of its label as it stands for, so that probabilities follow
the share of toxic labels in all of them, at any size.

Defined results: a null or empty text has no segment and gets the lowest score;
labels that are null, or whose id is null or missing among the documents, teach
nothing; an id labelled twice teaches its highest label; without labels of both
kinds every score is the share of toxic labels, or 0; repeated rows are scored
alike; an empty table gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import Splitter, Words, in_batches, non_letter_bytes, stretches

SAMPLE = 12_000
LEXICON = 4096
PREFIXES = (5, 6, 7, 8)
PRIOR, FLAT = 0.1, 0.5  # the prior's weight: a share of a feature's own use, and a flat part
BINS, TOP = 240, 60.0
SIGNIFICANT = 0.01


def token_features(splitter: Splitter, words: Words) -> list[np.ndarray]:
    """Hashes of each token and of its prefixes; a token shorter than a prefix repeats its own."""
    size = words.ends - words.starts
    out = [words.hashes]
    for length in PREFIXES:
        end = np.minimum(words.starts + length, words.ends)
        partial = splitter.stretch(words.starts, end) ^ np.uint64(length)
        out.append(np.where(size > length, partial, words.hashes))
    return out


@dataclass
class Lexicon:
    """Features with positive scores, and what turns segments into probabilities."""

    features: np.ndarray
    scores: np.ndarray
    penalty: float = 0.05
    scale: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def token_scores(self, features: list[np.ndarray]) -> np.ndarray:
        """The best feature's score of each token, 0 where none is in the lexicon."""
        out = np.zeros(len(features[0]))
        if not len(self.features):
            return out
        seen = np.zeros(1 << 18, bool)
        seen[(self.features >> np.uint64(46)).astype(np.int64)] = True
        for values in features:
            near = np.flatnonzero(seen[(values >> np.uint64(46)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.features, values[near]), len(self.features) - 1)
            hit = self.features[at] == values[near]
            out[near[hit]] = np.maximum(out[near[hit]], self.scores[at[hit]])
        return out


def maximal_segments(places: np.ndarray, gains: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text.

    Only tokens with a gain are given; every token in between costs the penalty.
    Linear: candidates are closed once no sum before one is smaller than the next's,
    and each keeps the place of the nearest before it whose sum is smaller.
    """
    closed: list[list[float]] = []
    kept: list[list[float]] = []  # first, last, sum before it, sum after it, that place or -1
    total, last = 0.0, -1
    for place, gain in zip(places.tolist(), gains.tolist()):
        total -= penalty * (place - last - 1)
        last = place
        segment = [place, place, total, total + gain]
        total += gain
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= segment[2]:
                j = kept[j][4]
            if j < 0:
                closed += kept
                kept = [[*segment, j]]
                break
            if kept[j][3] >= segment[3]:
                kept.append([*segment, j])
                break
            segment[0], segment[2], link = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = link
    return [(int(first), int(end), after - before) for first, end, before, after, _ in closed + kept]


def surprise(score: float, size: int, scale: float) -> float:
    """Minus the log of the chance that clean text of this size has a segment so high."""
    expected = size * np.exp(-min(scale * score, 700.0))
    return float(-np.log(-np.expm1(-expected))) if expected > 1e-12 else float(scale * score - np.log(size))


def text_segments(
    splitter: Splitter, lexicon: Lexicon, texts: pa.Array
) -> Iterator[tuple[float, list[tuple[int, int, float, float]]]]:
    """Evidence and significant segments (first token, last token, score, surprise) of each text."""
    limit = -np.log(SIGNIFICANT)
    for _, _, data, offsets in stretches(texts):
        words = splitter.split(data, offsets)
        gain = lexicon.token_scores(token_features(splitter, words))
        hits = np.flatnonzero(gain)
        cuts = np.searchsorted(hits, words.bounds)
        for row, size in enumerate(words.counts.tolist()):
            mine = hits[cuts[row] : cuts[row + 1]]
            if not len(mine):
                yield 0.0, []
                continue
            found = [
                (first, last, score, surprise(score, size, lexicon.scale))
                for first, last, score in maximal_segments(
                    mine - words.bounds[row], gain[mine], lexicon.penalty
                )
            ]
            found.sort(key=lambda segment: -segment[3])
            strong = [segment for segment in found if segment[3] >= limit]
            evidence = found[0][3] + sum(segment[3] - limit for segment in strong[1:])
            yield min(evidence, TOP), strong


def letter_splitter() -> Splitter:
    return Splitter(lower=True, separators=non_letter_bytes())


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each label that have a feature, from (toxic, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = letter_splitter()
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, _, data, offsets in stretches(batch.column(1)):
                words = splitter.split(data, offsets)
                features = token_features(splitter, words)
                for row, (begin, end) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                    keys.append(np.unique(np.concatenate([values[begin:end] for values in features])))
                    marks.append(np.full(len(keys[-1]), label[first + row]))
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            mark = np.concatenate(marks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(distinct.view(np.int64)),
                    *[pa.array(np.bincount(place, mark == side, len(distinct)).astype(np.int64)) for side in (1, 0)],
                ],
                names=["feature", "toxic", "clean"],
            )

    return (
        in_batches(labelled)
        .select("toxic", "text")
        .mapInArrow(count, "feature bigint, toxic bigint, clean bigint")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def log_odds(counts: DataFrame) -> DataFrame:
    """Counts with ``odds`` and its significance ``z``; the prior follows overall use."""
    sums = counts.agg(
        F.sum("toxic").cast("double").alias("t"), F.sum("clean").cast("double").alias("c"), F.count("*").alias("n")
    ).first()
    all_toxic, all_clean = sums["t"] or 0.0, sums["c"] or 0.0
    weight = PRIOR * (all_toxic + all_clean) + FLAT * sums["n"]
    prior = (F.col("toxic") + F.col("clean")) * PRIOR + FLAT
    ours, theirs = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(ours / (all_toxic + weight - ours)) - F.log(theirs / (all_clean + weight - theirs))
    return counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / ours + 1 / theirs))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE
) -> tuple[DataFrame, dict[int, float]]:
    """(toxic, text) of at most about ``most`` documents of each label that may teach, and each label's share drawn.

    The sample's ids are bounded by the parameter, so they are broadcast and no
    text is shuffled.
    """
    marked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    counts = {row["toxic"]: row["count"] for row in marked.groupBy("toxic").count().collect()}
    shares = {label: most / max(most, counts.get(label, 0)) for label in (1, 0)}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    draw = F.crc32(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))) / float(1 << 32)
    return docs.select("doc_id", "text").join(F.broadcast(marked.filter(draw < share)), "doc_id"), shares


def karlin_scale(scores: np.ndarray, rates: np.ndarray, penalty: float) -> float:
    """The positive root of sum p * exp(scale * score) = 1 over clean tokens."""
    rest = max(1e-9, 1 - rates.sum())

    def excess(x: float) -> float:
        return float(rates @ np.exp(x * scores) + rest * np.exp(-x * penalty) - 1)

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through binned evidence, lightly shrunk."""
    design = np.stack([np.ones(len(evidence)), evidence], axis=1)
    beta = np.array([0.0, 0.1])
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        total = toxic + clean
        gradient = design.T @ (toxic - total * chance) - np.array([0.0, 0.01]) * beta
        weight = total * chance * (1 - chance)
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + np.diag([1e-6, 0.01]), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit_lexicon(docs: DataFrame, labels: DataFrame, learn: Column) -> Lexicon:
    """Features, penalty, extreme-value scale and curve from a bounded sample.

    ``learn`` tells by ``doc_id`` which labels may be used. The driver gets the
    lexicon and two histograms, all of fixed size.
    """
    sample, shares = labelled_sample(docs, labels, learn)
    strong = (
        log_odds(feature_counts(sample))
        .filter((F.col("toxic") >= 3) & (F.col("z") > 3) & (F.col("odds") > 0))
        .orderBy(F.desc("z"), "feature")
        .limit(LEXICON)
        .select("feature", "odds")
        .toPandas()
    )
    features = strong["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(features)
    lexicon = Lexicon(features[order], strong["odds"].to_numpy(float)[order])
    bins = np.linspace(0, max(lexicon.scores.max(initial=0.0), 1.0), 65)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = letter_splitter()
        for batch in batches:
            hist = np.zeros(len(bins))
            for _, _, data, offsets in stretches(batch.column(0)):
                words = splitter.split(data, offsets)
                gain = lexicon.token_scores(token_features(splitter, words))
                at = np.searchsorted(bins, gain[gain > 0])
                hist += np.bincount(at, minlength=len(bins))
                hist[0] += len(gain) - len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(bins)), pa.int64()), pa.array(hist.astype(np.int64))], names=["bin", "n"]
            )

    clean = in_batches(sample).filter("toxic = 0").select("text").mapInArrow(rates, "bin bigint, n bigint")
    counted = {row["bin"]: row["n"] for row in clean.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    hist = np.array([counted.get(i, 0) for i in range(len(bins))], float)
    share = hist[1:] / max(1.0, hist.sum())
    lexicon.penalty = max(0.05, 2 * float(share @ bins[1:]))
    lexicon.scale = karlin_scale(bins[1:], share, lexicon.penalty)

    width = TOP / BINS
    scored = evidence_of(sample, lexicon, ["toxic"])
    rows = scored.groupBy("toxic", F.floor(F.col("evidence") / width).alias("bin")).count().collect()
    toxic, other = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for row in rows:
        (toxic if row["toxic"] else other)[row["bin"]] += row["count"] / shares[row["toxic"]]
    if toxic.sum() and other.sum():
        lexicon.intercept, lexicon.slope = fit_curve((np.arange(BINS + 1) + 0.5) * width, toxic, other)
    elif toxic.sum():
        lexicon.intercept = 20.0
    return lexicon


def evidence_of(docs: DataFrame, lexicon: Lexicon, carried: list[str]) -> DataFrame:
    """The carried columns, the evidence, and the significant passages in token numbers."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = letter_splitter()
        for batch in batches:
            found = list(text_segments(splitter, lexicon, batch.column(batch.num_columns - 1)))
            passages = [
                [dict(zip(("first", "last", "score", "surprise"), segment)) for segment in strong]
                for _, strong in found
            ]
            kind = pa.struct(
                [("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("surprise", pa.float64())]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([evidence for evidence, _ in found], pa.float64()),
                    pa.array(passages, pa.list_(kind)),
                ],
                names=[*carried, "evidence", "passages"],
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)
    return in_batches(docs).select(*carried, F.col("text").alias("_text")).mapInArrow(
        score,
        f"{types}, evidence double, passages array<struct<first:bigint,last:bigint,score:double,surprise:double>>",
    )


def score_documents(docs: DataFrame, lexicon: Lexicon, carried: list[str]) -> DataFrame:
    """The carried columns with ``score``, ``predicted`` and ``passages``."""
    chance = 1 / (1 + F.exp(-(F.lit(lexicon.intercept) + F.lit(lexicon.slope) * F.col("evidence"))))
    return evidence_of(docs, lexicon, carried).select(
        *carried,
        chance.alias("score"),
        F.when(chance >= 0.5, 1).otherwise(0).alias("predicted"),
        "passages",
    )


def teaching_fold(key: Column) -> Column:
    """Whether labels of a document may be learned from: its checksum modulo 5 is not 0."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 0, F.lit(False))


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    lexicon = fit_lexicon(docs, labels, teaching_fold(F.col("doc_id")))
    marked = docs.select("doc_id", (~teaching_fold(F.col("doc_id"))).alias("held_out"), "text")
    return score_documents(marked, lexicon, ["doc_id", "held_out"]).drop("passages")
