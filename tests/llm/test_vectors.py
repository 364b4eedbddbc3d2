"""The operators on vectors against brute force, and on awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, graph, rangejoin

ODD = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, []),
       (905, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (906, [1.0, 2.0])]


def groups(seed, count=60):
    """Unit vectors in tight groups, with exact copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(count):
        base = rng.normal(size=8)
        for copy in range(rng.integers(1, 6)):
            rows.append((base + rng.normal(size=8) * 0.25).astype(np.float32))
    rows += rows[:4]
    return [(i, [float(x) for x in row]) for i, row in enumerate(rows)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (50, 51), (51, 50)]
    found = {row["node"]: row["component"] for row in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 130)} == {100} and found[51] == 50
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("cell,own,guest", [(8192, 16384, 65536), (25, 10, 12)])
def test_range_join_against_all_pairs(vectors, monkeypatch, cell, own, guest):
    monkeypatch.setattr(rangejoin, "CELL", cell)
    monkeypatch.setattr(rangejoin, "OWN_BLOCK", own)
    monkeypatch.setattr(rangejoin, "VISITOR_BLOCK", guest)
    rows = groups(1)
    points = np.array([row for _, row in rows])
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1))
        if (new == root).all():
            break
        root = new
    found = {row["vec_id"]: row for row in rangejoin.near_vectors(vectors(rows + ODD)).collect()}
    assert len(found) == len(rows) + len(ODD)
    for i, _ in rows:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (near[i].sum(), root[i], root[i] == i)
    for i, _ in ODD:
        assert found[i]["n_links"] == 0 and found[i]["component_id"] == i


def test_range_join_of_nothing_and_of_repeated_rows(vectors):
    assert rangejoin.near_vectors(vectors([])).count() == 0
    assert rangejoin.near_vectors(vectors(ODD)).count() == len(ODD)
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])]
    found = rangejoin.near_vectors(vectors(rows)).collect()
    assert sorted((row["vec_id"], row["n_links"], row["component_id"]) for row in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_range_join_of_several_lengths_and_of_ids_with_several_vectors(vectors):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0])] + [(10 + i, [1.0, float(i), 3.0 * (i % 2)]) for i in range(5)]
    found = {row["vec_id"]: row for row in rangejoin.near_vectors(vectors(rows)).collect()}
    assert [(found[i]["n_links"], found[i]["component_id"]) for i in (1, 2)] == [(1, 1), (1, 1)]
    # Id 3 names three vectors, of which one links with 5 and one with 4; id 4 a vector and a null.
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 2.0]), (4, None), (6, [3.0, 0.0])]
    result = rangejoin.near_vectors(vectors(rows)).collect()
    assert sorted(tuple(row) for row in result) == sorted([
        (5, 2, 3, False), (3, 2, 3, True), (6, 2, 3, False), (3, 1, 3, True), (4, 1, 3, False),
        (3, 0, 3, True), (4, 0, 4, True),
    ])


def test_search_of_several_lengths_and_of_ids_with_several_vectors(vectors):
    rows = [(20, [1.0, 0.0]), (1, [3.0, 0.0]), (40, [1.0, 0.0, 0.0]), (2, [2.0, 1.0, 0.0]), (60, [1.0])]
    found = ann.search(vectors(rows), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [tuple(row) for row in found] == [(20, 1, 1, 3.0), (40, 1, 2, 2.0)]
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (7, [2.0, 5.0])]
    found = ann.search(vectors(rows), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(tuple(row) for row in found) == [(20, 1, 7, 2.0), (20, 1, 7, 5.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]


def test_search_recall_and_exact_scores(vectors):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(3000, 16)).astype(np.float32)
    points[1::7] *= 3
    points[5] = points[6]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(points)]
    found = ann.search(vectors(rows + [(i, v[:1]) if v else (i, v) for i, v in ODD]), F.col("vec_id") % 20 == 0, 20).collect()
    exact = points.astype(float)
    by_query = {}
    for row in found:
        by_query.setdefault(row["query_id"], []).append(row)
    hits = 0
    for query in range(0, 3000, 20):
        scores = exact @ exact[query]
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != query][:20]
        mine = sorted(by_query[query], key=lambda row: row["rank"])
        assert [row["rank"] for row in mine] == list(range(1, 21))
        assert all(row["score"] == pytest.approx(scores[row["vec_id"]], abs=1e-12) for row in mine)
        assert [(-row["score"], row["vec_id"]) for row in mine] == sorted((-row["score"], row["vec_id"]) for row in mine)
        hits += len({row["vec_id"] for row in mine} & set(order))
    assert hits / (150 * 20) >= 0.9


def test_search_finds_all_when_few(vectors):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.0]), (2, [0.5, 0.0]), (20, [0.0, 1.0])]
    found = ann.search(vectors(rows), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [tuple(row) for row in found] == [
        (0, 1, 2, 0.5), (0, 2, 3, 0.5), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 2, 0.0), (20, 3, 3, 0.0),
    ]
    assert ann.search(vectors([]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors([(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
