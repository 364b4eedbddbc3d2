"""Radix trees of turn ids against plain Python, with small blocks and trees."""

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import radix
from ledgerloom.llm.order import numbered
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, id string"


def content(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16], len(text)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), *content(role, text)))
    for turns in convs.values():
        turns.sort()
    whole = {}
    for conv, turns in convs.items():
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        h = zlib.crc32(str(conv).encode()) % 9
        whole[conv] = [t[1:] for t in convs.get(base, [])[:h] + turns[h:]]
    nodes = {}
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(path))))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below),
            sum((len(nodes[p]) - 1) * p[-1][1] for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = [tuple(row) for row in radix.prefix_nodes(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("block, tree", [(256, 200_000), (2, 5), (3, 12)])
def test_nodes_equal_brute_force(spark, monkeypatch, block, tree):
    monkeypatch.setattr(radix, "BLOCK", block)
    monkeypatch.setattr(radix, "TREE_TURNS", tree)
    rng = random.Random(block)
    rows = []
    for conv in [*range(-7, 40), 10**12, 10**12 + 3]:
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            word = "same opening" if turn < 2 else rng.choice(["yes", "no", "é"])
            rows.append((conv, turn, rng.choice(["user", "user", None]) if turn > 3 else "user", word))
    check(spark, rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK", 4)
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "a", "b"), (1, 0, "a", "b"), (None, 1, "x", "y"),
        (7, 3, "ab", "c"), (7, 2, "a", "bc"), (9, -1, "user", None), (500, 1, "user", "x" * 100_000),
    ]
    check(spark, rows + [(15, t, "user", "again") for t in range(40)] + [(16, t, "user", "again") for t in range(40)])
    check(spark, [])


@pytest.mark.parametrize("size", [3, 4, 5, 16, 17, 48, 49, 256])
def test_layouts_grow_and_keep_order(size):
    keys = [bytes([i, 1, 2]) for i in range(size)]
    root = radix.insert(None, b"\xff\xff", 0) if size < 256 else None
    for key in random.Random(1).sample(keys, size):
        root = radix.insert(root, key, key)
    found = [kid.byte for kid in root.children()]
    assert found == sorted(found) and len(found) == size + (size < 256)
    kind = radix.Sorted if len(found) <= 16 else radix.Indexed if len(found) <= 48 else radix.Direct
    assert type(root.below) is kind


def test_places_of_a_group_that_lies_in_several_tasks(spark):
    rows = [(1 if i % 3 else None, 7 * i % 1000) for i in range(1000)]
    frame = spark.createDataFrame(rows, "g int, v int").repartition(8)
    got = numbered(frame, ["g"], [F.col("v")], "place").collect()
    for group in (1, None):
        values = sorted(v for g, v in rows if g == group)
        assert [r["v"] for r in sorted((r for r in got if r["g"] == group), key=lambda r: r["place"])] == values
        assert sorted(r["place"] for r in got if r["g"] == group) == list(range(1, len(values) + 1))
