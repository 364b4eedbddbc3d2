"""Small tables with nulls, empty, blank, long and repeated texts, ties and clashing columns."""

import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(texts):
    return [(i, text, "en", "s", len(text or "")) for i, text in texts]


@pytest.fixture
def documents(spark):
    """A maker of document tables from (doc_id, text) pairs, split over several partitions."""

    def make(texts, extra=()):
        schema = DOCUMENTS + "".join(f", {name} string" for name in extra)
        rows = [row + ("clash",) * len(extra) for row in rows_of(texts)]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture
def edges(documents):
    """Every awkward row at once; the extra columns carry names that operators use inside."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five six"),
        (5, "one two three four five six"), (6, long), (7, long), (None, "null id text here"),
        (None, None), (8, "éß \U0001f600 中文"), (9, "1234 5678 !!"),
    ]
    return documents(texts, ("score", "key", "tokens", "blob", "weight", "_text", "spans"))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def vectors(spark):
    def make(rows):
        schema = T.StructType(
            [
                T.StructField("vec_id", T.LongType()),
                T.StructField("embedding", T.ArrayType(T.FloatType())),
                T.StructField("score", T.StringType()),
            ]
        )
        return spark.createDataFrame([(*row, "clash") for row in rows], schema).repartition(3)

    return make
