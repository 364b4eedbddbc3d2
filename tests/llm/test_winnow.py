"""Winnowing against plain Python, over pieces of any size and awkward rows."""

import random
import re

import pytest

from ledgerloom.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        words = cut(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    rows = []
    for doc, text in docs:
        words, hit, found = cut(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        names = sorted(str(item) for item in found if item is not None)
        rows.append((doc, len(words), len(hit), len(names), names, bool(hit)))
    return rows


def check(spark, docs, items, width=10):
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id bigint, text string, doc_id string")
    got = [tuple(row) for row in winnow.contamination(d, b, width).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, items, width)))


@pytest.mark.parametrize("piece", [1 << 16, 30])
def test_spans_at_every_place_and_length(spark, monkeypatch, piece):
    monkeypatch.setattr(winnow, "PIECE", piece)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 7, 9, 10, 14, 40])))) for i in range(12)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(60))]
        source = items[rng.randrange(12)][1].split()
        begin = rng.randrange(len(source))
        at = rng.randrange(len(words) + 1)
        words[at:at] = source[begin : begin + rng.randrange(1, 16)]
        docs.append((i, rng.choice([" ", ", ", "\n--"]).join(words).title()))
    check(spark, docs, items)


def test_awkward_rows(spark):
    span = "a b c d e f g h i j"
    docs = [
        (1, None), (2, ""), (3, " ,; "), (4, span), (4, span), (None, span + " k"), (5, f"x {span} {span}"),
        (6, "É中文 1234 " * 30), (7, "word " * 40_000 + span), (8, "a b c"), (9, "two words"),
    ]
    items = [
        (10, span + " zz"), (2, span), (2, "other words of the item that has the same id as another"), (None, "two words"),
        (3, None), (4, ""), (5, "!!"), (6, "É中文 1234 " * 6),
    ]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


def test_joined_fingerprints_say_the_same_as_sent_ones(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SENT", -1)
    span = "a b c d e f g h i j k l"
    check(spark, [(1, f"x {span} y"), (2, "a b"), (3, None)], [(1, span), (2, "a b")])
