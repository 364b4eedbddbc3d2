"""Best rules by bound equal the best of all rules."""

import itertools

import numpy as np
import pytest

from ledgerloom.operators import baskets, bestrules


def _sets(spark, transactions, least):
    """All item sets of (segment, items) baskets that are in at least so many of a segment's baskets."""
    rows = []
    for segment in sorted({segment for segment, _ in transactions}):
        held = [frozenset(items) for key, items in transactions if key == segment]
        names = sorted(set().union(*held))
        for size in range(1, len(names) + 1):
            for items in itertools.combinations(names, size):
                freq = sum(basket.issuperset(items) for basket in held)
                if freq >= least:
                    rows.append((segment, list(items), freq, len(held)))
    schema = "segment int, items array<string>, freq bigint, baskets bigint"
    return spark.createDataFrame(rows, schema).cache()


def _same(sets, count, min_lift=1.0):
    every = baskets.top_rules(baskets.drop_mirrored(baskets.association_rules(sets, min_lift)), count)
    got = bestrules.best_rules(sets, count, min_lift)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, every.collect()))
    return rows


@pytest.mark.parametrize("count", [1, 10])
def test_equal_to_the_best_of_all_rules(spark, count):
    rng = np.random.default_rng(count)
    transactions = []
    for segment in (0, 1):
        for _ in range(40):
            common = rng.random() < 0.4
            chances = np.where(np.arange(7) < 4, 0.9 if common else 0.25, 0.35)
            items = [name for name, hit in zip("gfedcba", rng.random(7) < chances) if hit]
            transactions.append((segment, items or ["z"]))
    rows = _same(_sets(spark, transactions, 2), count)
    assert len(rows) >= min(count, 20)


def test_ties_of_items_always_together(spark):
    # Every split of every set has the same lift and support; order alone decides.
    transactions = [(5, list("abcdef"))] * 3 + [(5, ["x"])] * 7
    rows = _same(_sets(spark, transactions, 3), 10)
    assert rows[0][2:4] == ("a", "b") and len(rows) == 10
    _same(_sets(spark, transactions, 3), 40)


def test_wide_splits_can_win(spark):
    # abcd splits best into ab and cd, which no single consequent shows.
    transactions = [(1, list("abcd"))] * 4 + [(1, ["a"])] * 9 + [(1, ["b"])] * 9
    transactions += [(1, ["c"])] * 9 + [(1, ["d"])] * 9 + [(1, ["a", "c"])] * 6 + [(1, ["b", "d"])] * 6
    rows = _same(_sets(spark, transactions, 2), 1)
    assert rows[0][2:4] == ("a, b", "c, d")


@pytest.mark.parametrize("together, lacking, first", [(10, 10, 10), (20, 18, 18), (20, 12, 17)])
def test_a_large_set_is_not_split_in_all_ways(spark, monkeypatch, together, lacking, first):
    # One set of 20 items has 2^19 splits. Its pairs hold equally often, its 19 subsets of 19 items
    # so often that it falls behind: by the order of ties, or by its bound.
    names = [f"i{n:02}" for n in range(20)]
    freq = {tuple(names): 10}
    for n, item in enumerate(names):
        freq[(item,)] = together
        freq[tuple(names[:n] + names[n + 1 :])] = lacking if n else first
    freq |= {pair: together for pair in itertools.combinations(names, 2)}
    rows = [(0, list(items), count, 100) for items, count in freq.items()]
    sets = spark.createDataFrame(rows, "segment int, items array<string>, freq bigint, baskets bigint")
    sizes = []
    deal = bestrules._deal
    monkeypatch.setattr(bestrules, "_deal", lambda splits: sizes.append(splits.count()) or deal(splits))
    got = bestrules.best_rules(sets, 10).collect()
    assert [row.antecedents for row in got] == ["i00"] * 10
    assert sum(sizes) < 100


def test_few_rules_and_none(spark):
    few = _sets(spark, [(1, ["a", "b"]), (1, ["c"])], 1)
    assert [row[2:4] for row in _same(few, 10)] == [("a", "b")]
    assert _same(few.filter("false"), 10) == []
    assert _same(few, 10, min_lift=5.0) == []
