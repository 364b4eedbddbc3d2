"""Shared expressions, quantiles and profiling."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import days_between, half_even, half_up, order_bucket
from ledgerloom.operators import quality
from ledgerloom.operators.quantiles import exact_quantiles, quantile_segments


def test_days_are_elapsed_24_hour_days(spark):
    rows = [
        (datetime(2011, 12, 8, 23, 59), datetime(2011, 12, 10, 0, 1)),
        (datetime(2011, 12, 8, 23, 59), datetime(2011, 12, 9, 0, 1)),
    ]
    frame = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r.d for r in frame.select(days_between(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [1, 0]


def test_days_ignore_the_session_time_zone(spark):
    rows = [(datetime(2011, 3, 26, 12), datetime(2011, 3, 27, 12))]
    frame = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        assert frame.select(days_between(F.col("a"), F.col("b"))).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rounding_modes(spark):
    frame = spark.createDataFrame([(2.5, 0.125)], "a double, b double")
    row = frame.select(
        half_even(F.col("a"), 0), half_up(F.col("a"), 0), half_even(F.col("b"), 2), half_up(F.col("b"), 2)
    ).first()
    assert tuple(row) == (2.0, 3.0, 0.12, 0.13)


def test_order_bucket_preserves_order(spark):
    values = sorted(np.random.default_rng(1).normal(0, 1000, 500).tolist() + [0.0, -0.5, 0.5])
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", order_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    buckets = [r.b for r in rows]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles_match_linear_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame(
        {
            "heavy": np.exp(rng.normal(3, 4, 501)),
            "signed": rng.normal(0, 10, 501),
            "tied": rng.integers(0, 4, 501).astype(float),
        }
    )
    probabilities = [0.0, 0.1, 0.25, 0.5, 2 / 3, 1.0]
    got = exact_quantiles(spark.createDataFrame(data), list(data), probabilities).collect()
    assert len(got) == 18
    for row in got:
        assert row.value == pytest.approx(np.quantile(data[row.feature], row.probability), rel=1e-12)


def test_quantile_segments_number_from_the_top(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    rows = {r.v: r.segment for r in quantile_segments(frame, "v", 3).collect()}
    assert rows[8.0] == 0 and rows[0.0] == 2
    assert sorted(rows.values()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_summary_statistics(spark):
    frame = spark.createDataFrame([(1,), (2,), (3,), (10,)], "v int")
    row = quality.summary_statistics(frame, ["v"]).first()
    assert (row["count"], row["mean"], row["std"]) == (4, 4.0, 4.08)
    assert (row["q25"], row["q50"], row["q75"]) == (1.75, 2.5, 4.75)


def test_missing_counts_nan_in_float_columns(spark):
    frame = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    counts = {r.Column: r.MissingCount for r in quality.missing_counts(frame).collect()}
    assert counts == {"x": 2, "s": 1}
    assert quality.rows_with_missing(frame).count() == 2


def test_fence_and_box(spark):
    values = [float(v) for v in range(1, 12)] + [100.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    fence = quality.iqr_fence(frame, "v").first()
    assert fence.upper_fence == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert quality.without_outliers(frame, "v").count() == 11
    box = quality.box_statistics(frame, "v").first()
    assert (box.whisker_low, box.whisker_high, box.fliers_low, box.fliers_high) == (1.0, 11.0, 0, 1)


def test_histogram_closes_the_last_bin(spark):
    values = np.random.default_rng(5).uniform(3, 9, 300)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.bin: r["count"] for r in quality.histograms(frame, {"v": 10}).collect()}
    expected, _ = np.histogram(values, 10)
    assert [got.get(i, 0) for i in range(10)] == expected.tolist()


def test_histogram_of_a_constant(spark):
    frame = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [(r.bin, r["count"]) for r in quality.histograms(frame, {"v": 5}).collect()] == [(0, 2)]


def test_correlation_matrix(spark):
    data = pd.DataFrame(np.random.default_rng(0).normal(size=(50, 3)), columns=["a", "b", "c"])
    data["c"] += data["a"]
    got = quality.correlation_matrix(spark.createDataFrame(data), ["a", "b", "c"]).collect()
    expected = data.corr().round(2)
    assert len(got) == 9
    assert all(r.r == expected.loc[r.feature_x, r.feature_y] for r in got)
