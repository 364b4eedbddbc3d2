"""Feature scaling and the train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardise(
    frame: DataFrame,
    columns: Sequence[str],
    fit_on: DataFrame | None = None,
    suffix: str = "_scaled",
) -> DataFrame:
    """Add (x - mean) / population deviation of each column; a constant scales to 0.

    The moments come from one aggregation of ``fit_on`` (the frame itself by
    default), read as a scalar subquery of one row.
    """
    source = frame if fit_on is None else fit_on
    moments = source.agg(
        F.struct(
            *[F.avg(F.col(name).cast("double")).alias(f"{name}_mean") for name in columns],
            *[F.stddev_pop(F.col(name).cast("double")).alias(f"{name}_dev") for name in columns],
        )
    )
    scaled = {}
    for name in columns:
        centred = F.col(name).cast("double") - F.col(f"_moments.{name}_mean")
        spread = F.col(f"_moments.{name}_dev")
        scaled[f"{name}{suffix}"] = F.when(spread == 0, F.lit(0.0)).otherwise(centred / spread)
    return frame.withColumn("_moments", moments.scalar()).withColumns(scaled).drop("_moments")


def assemble(frame: DataFrame, columns: Sequence[str], output: str = "point") -> DataFrame:
    """Gather columns into one vector beside the row's own key."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(frame)


def train_test_split(
    frame: DataFrame, key: str = "CustomerID", test_share: float = 0.2
) -> DataFrame:
    """Add ``is_test``: true for the ceil(share * n) rows with the smallest key digests.

    The cut-off digest is found exactly from counts per digest prefix (at most
    65,536) and the few rows that share the deciding prefix, so nothing is sorted
    as a whole and every engine picks the same rows.
    """
    digests = frame.select(F.md5(F.col(key).cast("string")).alias("digest"))
    prefix = F.substring("digest", 1, 4)
    running = Window.partitionBy(F.lit(0)).orderBy("prefix")
    rows = F.sum("copies").over(Window.partitionBy(F.lit(0)))
    wanted = F.ceil(F.col("rows") * F.lit(test_share))
    deciding = (
        digests.groupBy(prefix.alias("prefix"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("rows", rows)
        .withColumn("upto", F.sum("copies").over(running))
        .filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("copies") < wanted))
        .select("prefix", (wanted - (F.col("upto") - F.col("copies"))).alias("place"))
    )
    cutoff = (
        digests.withColumn("prefix", prefix)
        .join(F.broadcast(deciding), "prefix")  # one row
        .withColumn("row", F.row_number().over(Window.partitionBy("prefix").orderBy("digest")))
        .filter(F.col("row") == F.col("place"))
        .select("digest")
    )
    return frame.withColumn("is_test", F.md5(F.col(key).cast("string")) <= cutoff.scalar())
