"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources import schemas, workbook


def load_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the transaction table from Parquet, ORC, JSON, CSV or workbooks with a fixed schema."""
    if fmt == workbook.FORMAT:
        return workbook.read_workbooks(spark, path, schemas.TRANSACTIONS)
    reader = spark.read.schema(schemas.TRANSACTIONS)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One star-schema table; the given schema saves the footer-reading job."""
    return spark.read.schema(schemas.STAR_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def flatten_arrays(frame: DataFrame, separator: str = ", ") -> DataFrame:
    """Join array columns to sorted text, since text formats have no arrays."""
    arrays = {
        field.name: F.concat_ws(separator, F.array_sort(field.name))
        for field in frame.schema.fields
        if isinstance(field.dataType, T.ArrayType)
    }
    return frame.withColumns(arrays) if arrays else frame


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write CSV with a header; the group key, if any, is an ordinary column."""
    flatten_arrays(frame).write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_partitioned(
    frame: DataFrame, path: str, keys: list[str], fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """One output folder per key value, for instance per cluster.

    The rows are not shuffled by key first: a cluster holding a third of all
    rows is still written by every task that has some of it.
    """
    if fmt == "csv":
        frame = flatten_arrays(frame)
    frame.write.mode(mode).partitionBy(*keys).option("header", True).format(fmt).save(path)
