"""The Merkle manifest against plain Python, with small arrays and ids of every kind."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc, text, lang, source, n = row
    values = [doc, source, lang, None if n is None else n + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The root and, for every node, its (left, right) siblings from the bottom up."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j, mine in enumerate(owners[i : i + 2]):
                for owner in mine:
                    paths[owner].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h(*run))
            over.append([o for mine in owners[i : i + 2] for o in mine])
        nodes, owners = above, over
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (mine, *climb([leaf(r) for r in mine]))
    root, tops = climb([trees[lang][1] for lang in langs]) if langs else ("", [])
    out = []
    for lang, top in zip(langs, tops):
        mine, subroot, paths = trees[lang]
        for row, path in zip(mine, paths):
            forged = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            text = leaf(row, 1) if forged else leaf(row)
            for a, b in path + top:
                text = h(a, text, b)
            proof = h("".join(a + b for a, b in path + top))
            out.append((row[0], leaf(row), subroot, root, proof, text, text == root))
    return out


def check(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, place string"
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema).repartition(3)
    got = [tuple(row) for row in manifest.manifest(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("bits", [10, 2])
def test_rows_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    monkeypatch.setattr(manifest, "SLOTS", 1 << bits)
    rng = random.Random(bits)
    ids = [*range(-20, 60), *[rng.randrange(-(1 << 63), 1 << 63) for _ in range(40)], 65535, 65536, -65536, -65537]
    langs = ["en"] * 5 + ["de", "é", None]
    rows = [(i, f"text {i} é", rng.choice(langs), "s", rng.choice([None, 5])) for i in ids]
    check(spark, rows)


def test_awkward_rows(spark):
    check(spark, [])
    check(spark, [(7, None, None, None, None)])
    rows = [(3, "a", "en", "s", 1)] * 3 + [(3, "b", "en", "s", 1), (None, "c", "en", None, 2), (None, "c", "en", None, 2)]
    rows += [(None, None, None, None, None), (4, "", "", "", 0), (2, "x" * 300_000, "en", "s", 300_000), (14, "y", "en", "s", 1)]
    check(spark, rows)


@pytest.mark.parametrize("size", [0, 1, 4094, 4095, 4096, 4097, 65_536])
def test_bitmaps_round_trip(size):
    low = np.sort(np.random.default_rng(size).permutation(65_536)[:size])
    data = manifest.packed(low)
    assert len(data) <= 8192 and (manifest.unpacked(data) == low).all()
