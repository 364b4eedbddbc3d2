"""Mixing sources to target weights: raking, then calibrated sampling.

Documents fall into cells, one for each combination of source, language and
topic. Iterative proportional fitting scales the token mass of the cells until
all three margins meet their targets at once; a document's weight is its cell's
mass over its cell's tokens. Documents are then kept with probabilities
proportional to the weights, scaled so that the expected tokens are the wanted
fraction of all, with no probability above one. Everything is built-in functions
on a table of cells, whose size follows the distinct combinations and not the
documents.

Defined results: a null source, language or topic is a value of its own, "(none)";
null and empty texts have no tokens, do not move any margin, and a cell without
tokens has weight one; a value without a target share gets weight zero; repeated
rows count and are drawn alike, since the draw depends on the id alone; an empty
table gives no rows. Columns besides the named ones are carried, not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise

WORDS = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"

# Layouts in order of precedence: characters, and the share of a text they make up at least, in percent.
LAYOUTS = (("capitals", "A-Z", 20), ("digits", "0-9", 10), ("symbols", r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", 10))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def layout_topic(text: Column) -> Column:
    """A topic by layout, for corpora that come without topics: capitals, digits, symbols or prose."""
    topic, size = F.lit("prose"), F.length(text).cast("bigint")
    for name, characters, percent in reversed(LAYOUTS):
        found = F.regexp_count(text, F.lit(f"[{characters}]")).cast("bigint") * 100
        topic = F.when(found >= F.greatest(size * percent, F.lit(1)), name).otherwise(topic)
    return topic


def _value(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NONE)).alias(name)


def token_cells(features: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Tokens of each combination of dimension values that has any."""
    return (
        features.groupBy(*[_value(name) for name in dimensions])
        .agg(F.sum("tokens").cast("double").alias("tokens"))
        .filter(F.col("tokens") > 0)
    )


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share) with shares proportional to tokens raised to ``power``."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("part"))
    total = sums.agg(F.sum("part")).scalar()
    return sums.select(F.col(dimension), (F.col("part") / total).alias("share"))


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    tolerance: float = 1e-6,
    most_rounds: int = 100,
) -> DataFrame:
    """Cells with their ``mass`` after fitting every margin to its target shares, and ``fitted``.

    ``targets`` maps a dimension to (dimension, share); shares should add up to
    one. A round fits the dimensions one after another by a grouped sum each; it
    ends when no margin is off by more than ``tolerance`` of its target, or after
    ``most_rounds``, since contradictory targets never meet; ``fitted`` tells which
    it was. The driver sees one number a round.
    """
    dimensions = list(targets)
    grid = cells.withColumn("mass", F.col("tokens"))
    for name in dimensions:
        grid = grid.join(targets[name].withColumnRenamed("share", f"share_{name}"), name, "left")
    shares = [f"share_{name}" for name in dimensions]
    grid = materialise(grid.fillna(0.0, shares), "cells")
    total = grid.agg(F.sum("tokens")).first()[0]
    if not total:
        return grid.drop(*shares).withColumn("fitted", F.lit(True))

    def margin(frame: DataFrame, name: str) -> DataFrame:
        return frame.join(frame.groupBy(name).agg(F.sum("mass").alias("sum")), name)

    fitted = False
    for _ in range(most_rounds):
        for name in dimensions:
            fitted = F.col("mass") * F.col(f"share_{name}") * total / F.col("sum")
            grid = margin(grid, name).withColumn(
                "mass", F.when(F.col("sum") > 0, fitted).otherwise(0.0)
            ).drop("sum")
        grid = materialise(grid, "cells")
        gaps = [
            grid.groupBy(name)
            .agg(F.sum("mass").alias("sum"), (F.first(f"share_{name}") * total).alias("goal"))
            .agg(F.max(F.when(F.col("goal") > 0, F.abs(F.col("sum") / F.col("goal") - 1))).alias("gap"))
            for name in dimensions[:-1]
        ]
        fitted = (reduce(DataFrame.unionByName, gaps).agg(F.max("gap")).first()[0] or 0.0) <= tolerance
        if fitted:
            break
    return grid.drop(*shares).withColumn("fitted", F.lit(fitted))


def calibrated(cells: DataFrame, fraction: float) -> DataFrame:
    """Raked cells with ``weight`` and ``probability``.

    The scale grows until the expected tokens are ``fraction`` of all while no
    probability exceeds one; each step fixes the cells that reached one.
    """
    weighed = cells.withColumn("weight", F.col("mass") / F.col("tokens"))
    scale, goal = fraction, None
    while True:
        full = F.col("weight") * scale >= 1
        sums = weighed.agg(
            F.sum("tokens").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("mass"))), F.lit(0.0)).alias("rest"),
        ).first()
        goal = fraction * (sums["all"] or 0.0)
        if not sums["rest"] or (goal - sums["full"]) / sums["rest"] <= scale * (1 + 1e-12):
            break
        scale = (goal - sums["full"]) / sums["rest"]
    return weighed.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * scale))


def draw(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key alone."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(
    docs: DataFrame,
    features: DataFrame,
    fraction: float = 0.5,
    power: float = 0.5,
    targets: Mapping[str, DataFrame] | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """``docs`` with weight, probability, fitted and selected.

    ``features`` has the dimensions and ``tokens`` of every document; ``docs``
    has the key and the dimensions, and may be the same table. Without
    ``targets``, every margin is tempered by ``power``.
    """
    cells = materialise(token_cells(features), "cells")
    goals = targets or {name: tempered_targets(cells, name, power) for name in DIMENSIONS}
    rates = materialise(
        calibrated(rake(cells, goals), fraction).select(*DIMENSIONS, "weight", "probability", "fitted"), "rates"
    )
    named = rates.toDF(*[f"_{name}" for name in rates.columns])
    same = reduce(
        Column.__and__, [F.coalesce(docs[name].cast("string"), F.lit(NONE)) == named[f"_{name}"] for name in DIMENSIONS]
    )
    probability = F.coalesce(F.col("_probability"), F.lit(1.0))
    return (
        docs.join(named, same, "left")
        .withColumn("weight", F.coalesce("_weight", F.lit(1.0)))
        .withColumn("probability", probability)
        .withColumn("fitted", F.coalesce("_fitted", F.lit(True)))
        .withColumn("selected", draw(F.col(key)) < F.col("probability"))
        .drop(*named.columns)
    )


def document_mix(docs: DataFrame, fraction: float = 0.5, power: float = 0.5) -> DataFrame:
    """Every document with its cell, tokens, weight, probability and whether it is drawn.

    Weight and probability are shown to six digits; the draw uses them unrounded.
    """
    features = materialise(
        docs.select(
            "doc_id",
            _value("source"),
            _value("lang"),
            F.coalesce(layout_topic(F.col("text")), F.lit(NONE)).alias("topic"),
            token_count(F.col("text")).alias("tokens"),
        ),
        "features",
    )
    drawn = mixed(features, features, fraction, power)
    return drawn.withColumn("weight", F.round("weight", 6)).withColumn("probability", F.round("probability", 6))


def oracle(fraction: float = 0.5, power: float = 0.5) -> str:
    """The same mix as SQL for the checking engine."""
    layouts = " ".join(
        f"WHEN regexp_matches(text, '[{characters}]') AND"
        f" 100 * length(regexp_replace(text, '[^{characters}]+', '', 'g')) >= {percent} * length(text) THEN '{name}'"
        for name, characters, percent in LAYOUTS
    )
    goals = ", ".join(
        f"t_{name} AS (SELECT {name}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER ()"
        f" AS s_{name} FROM cells GROUP BY {name})"
        for name in DIMENSIONS
    )
    fit = "ipf WHERE gap > 1e-6 AND r < 100"
    for name in DIMENSIONS:
        fit = (
            f"(SELECT * EXCLUDE (mass), mass * s_{name} * total / sum(mass) OVER (PARTITION BY {name})"
            f" AS mass FROM {fit})"
        )
    return f"""
WITH RECURSIVE features AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         CASE WHEN text IS NULL THEN 'prose' {layouts} ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM features
          GROUP BY ALL HAVING sum(tokens) > 0),
{goals},
ipf AS (
  SELECT 0 AS r, source, lang, topic, tokens, s_source, s_lang, s_topic,
         sum(tokens) OVER () AS total, 1e9::DOUBLE AS gap, tokens AS mass
  FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
  UNION ALL
  SELECT r + 1, source, lang, topic, tokens, s_source, s_lang, s_topic, total,
         max(greatest(abs(a / (s_source * total) - 1), abs(b / (s_lang * total) - 1))) OVER (), mass
  FROM (SELECT *, sum(mass) OVER (PARTITION BY source) AS a, sum(mass) OVER (PARTITION BY lang) AS b
        FROM {fit})),
raked AS (SELECT source, lang, topic, tokens, mass, total, mass / tokens AS weight FROM ipf
          WHERE r = (SELECT max(r) FROM ipf)),
steps AS (
  SELECT weight, ({fraction} * total - sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic) + tokens)
         / (sum(mass) OVER () - sum(mass) OVER (ORDER BY weight DESC, source, lang, topic) + mass) AS scale
  FROM raked),
best AS (SELECT arg_max(scale, weight) AS scale FROM steps WHERE scale * weight < 1),
rates AS (SELECT source, lang, topic, weight, least(1.0, weight * (SELECT scale FROM best)) AS probability,
                 (SELECT max(gap) FROM ipf WHERE r = (SELECT max(r) FROM ipf)) <= 1e-6 AS fitted FROM raked),
joined AS (SELECT f.*, coalesce(weight, 1.0) AS weight, coalesce(probability, 1.0) AS probability,
                  coalesce(fitted, true) AS fitted
           FROM features f LEFT JOIN rates USING (source, lang, topic))
SELECT * REPLACE (round(weight, 6) AS weight, round(probability, 6) AS probability),
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::UBIGINT / 4503599627370496.0
       < probability AS selected
FROM joined
"""
