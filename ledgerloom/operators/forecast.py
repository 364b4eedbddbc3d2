"""Forecasts of many daily series with an ARIMA(p, 1, 1) model.

Estimation follows Hannan and Rissanen (1982): a long autoregression of the
differenced series yields residuals, and a second least-squares fit uses lags of
both. Spark builds the lags with windows and sums the normal equations per
series; Python only solves one small system per series row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import half_even
from ledgerloom.operators.timeseries import SERIES


def lagged_differences(train: DataFrame, lags: int) -> DataFrame:
    """Add the first difference of Sales as ``d0`` and its lags ``d1`` ... ``d<lags>``."""
    by_date = Window.partitionBy(SERIES).orderBy("Date")
    changes = train.withColumn("d0", F.col("Sales") - F.lag("Sales").over(by_date))
    return changes.withColumns(
        {f"d{i}": F.lag("d0", i).over(by_date) for i in range(1, lags + 1)}
    )


def normal_sums(frame: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """Per series: flattened X'X and X'y over rows with no missing lag."""
    complete = F.lit(True)
    for name in [target, *predictors]:
        complete = complete & F.col(name).isNotNull()

    def total(x: str, y: str) -> Column:
        return F.coalesce(F.sum(F.when(complete, F.col(x) * F.col(y))), F.lit(0.0))

    return frame.groupBy(SERIES).agg(
        F.count_if(complete).alias("rows"),
        # Equal products are one sum, so only half of the symmetric matrix is added up.
        F.array(*[total(*sorted((x, y))) for x in predictors for y in predictors]).alias("xtx"),
        F.array(*[total(x, target) for x in predictors]).alias("xty"),
    )


def _solve(xtx: Sequence[float], xty: Sequence[float]) -> np.ndarray:
    """Least squares from normal equations; the shortest solution if they are singular."""
    right = np.asarray(xty, float)
    left = np.asarray(xtx, float).reshape(len(right), len(right))
    return np.linalg.lstsq(left, right, rcond=1e-12)[0]


def _coefficients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        solved = [_solve(x, y).tolist() for x, y in zip(batch["xtx"], batch["xty"])]
        yield pd.DataFrame({SERIES: batch[SERIES], "beta": solved})


def solve_series(sums: DataFrame) -> DataFrame:
    """One coefficient array per series."""
    kind = sums.schema[SERIES].dataType.simpleString()
    return sums.select(SERIES, "xtx", "xty").mapInPandas(
        _coefficients, f"{SERIES} {kind}, beta array<double>"
    )


def series_shocks(train: DataFrame, long_order: int = 8) -> DataFrame:
    """Lagged differences with the long autoregression's residual ``e0`` and the one before, ``e1``."""
    lagged = lagged_differences(train, long_order)
    lags = [f"d{i}" for i in range(1, long_order + 1)]
    first = solve_series(normal_sums(lagged, "d0", lags)).withColumnRenamed("beta", "long_beta")
    fitted = F.aggregate(
        F.zip_with(F.array(*lags), F.col("long_beta"), lambda x, b: x * b),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    by_date = Window.partitionBy(SERIES).orderBy("Date")
    return (
        lagged.join(first, SERIES)
        .withColumn("e0", F.col("d0") - fitted)
        .withColumn("e1", F.lag("e0").over(by_date))
        .drop("long_beta")
    )


def arima_forecast(
    train: DataFrame, steps: int = 7, p: int = 4, long_order: int = 8
) -> DataFrame:
    """The next days of each gap-free series: (series, Date, PredictedSales)."""
    shocks = series_shocks(train, long_order)
    lags = [f"d{i}" for i in range(1, long_order + 1)]
    second = normal_sums(shocks, "d0", [*lags[:p], "e1"])
    recent = [f"d{i}" for i in range(p)]
    state = F.struct("Date", "Sales", F.array(*recent).alias("changes"), F.col("e0").alias("shock"))
    last = shocks.groupBy(SERIES).agg(F.max_by(state, "Date").alias("last")).select(SERIES, "last.*")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = []
            for row in batch.itertuples(index=False):
                beta = _solve(row.xtx, row.xty)
                changes = list(np.nan_to_num(np.asarray(row.changes, float)))
                shock = 0.0 if pd.isna(row.shock) else float(row.shock)
                level, path = float(row.Sales), []
                for _ in range(steps):
                    step = float(beta[:p] @ np.asarray(changes[:p]) + beta[p] * shock)
                    changes.insert(0, step)
                    shock, level = 0.0, level + step
                    path.append(level)
                paths.append(path)
            yield pd.DataFrame({SERIES: batch[SERIES], "Date": batch["Date"], "path": paths})

    kind = train.schema[SERIES].dataType.simpleString()
    return (
        second.join(last, SERIES)
        .mapInPandas(extend, f"{SERIES} {kind}, Date date, path array<double>")
        .select(SERIES, "Date", F.posexplode("path").alias("step", "PredictedSales"))
        .select(SERIES, F.date_add("Date", F.col("step") + 1).alias("Date"), "PredictedSales")
    )


def naive_forecast(train: DataFrame, steps: int = 7) -> DataFrame:
    """The last known value repeated, the yardstick for any model."""
    last = train.groupBy(SERIES).agg(
        F.max("Date").alias("last"), F.max_by("Sales", "Date").alias("PredictedSales")
    )
    ahead = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    return last.withColumn("step", ahead).select(
        SERIES, F.date_add("last", F.col("step")).alias("Date"), "PredictedSales"
    )


def forecast_comparison(test: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual beside predicted sales, both rounded to cents."""
    return test.join(forecast, [SERIES, "Date"]).select(
        SERIES,
        "Date",
        half_even(F.col("Sales"), 2).alias("ActualSales"),
        half_even(F.col("PredictedSales"), 2).alias("PredictedSales"),
    )


def forecast_metrics(comparison: DataFrame, model: str, horizon: str) -> DataFrame:
    """MAE, RMSE and MAPE per series from the rounded values; zero actuals leave MAPE."""
    error = F.col("ActualSales") - F.col("PredictedSales")
    share = F.when(F.col("ActualSales") != 0, F.abs(error) / F.abs("ActualSales"))
    return comparison.groupBy(SERIES).agg(
        F.lit(model).alias("Model"),
        F.lit(horizon).alias("ForecastHorizon"),
        half_even(F.avg(F.abs(error)), 2).alias("MAE"),
        half_even(F.sqrt(F.avg(error * error)), 2).alias("RMSE"),
        half_even(F.avg(share) * 100, 2).alias("MAPE"),
    )
