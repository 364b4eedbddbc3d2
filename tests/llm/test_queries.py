"""Every registered corpus query against its SQL, or its shape, on the smallest given tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "labels", "benchmark", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(frame: pd.DataFrame) -> list:
    return sorted(map(repr, frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, engine, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert rows(got) == rows(engine.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"pipeline"}))
def test_query_covers_its_table(spark, engine, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    if "doc_id" in got:
        ids = engine.execute("SELECT doc_id FROM documents").df()["doc_id"]
        assert set(got["doc_id"]) == set(ids)
    else:
        asked = engine.execute("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").df()["vec_id"]
        assert set(got["query_id"]) == set(asked) and (got.groupby("query_id").size() == 20).all()
