"""ARIMA by exact likelihood against dense covariance matrices."""

from datetime import date, timedelta

import numpy as np
import pytest

from ledgerloom.operators import forecast, likelihood
from ledgerloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


def covariance(phi, theta, size, terms=4000):
    """Of consecutive values of an ARMA process with unit innovations, by its moving average form."""
    psi = np.zeros(terms)
    for i in range(terms):
        psi[i] = (i == 0) + (theta if i == 1 else 0) + sum(c * psi[i - k - 1] for k, c in enumerate(phi) if i > k)
    lags = np.array([psi[: terms - k] @ psi[k:] for k in range(size)])
    return lags[np.abs(np.subtract.outer(np.arange(size), np.arange(size)))]


def dense_likelihood(values, phi, theta):
    matrix = covariance(phi, theta, len(values))
    n, scale = len(values), values @ np.linalg.solve(matrix, values) / len(values)
    return -n / 2 * (np.log(2 * np.pi * scale) + 1) - np.linalg.slogdet(matrix)[1] / 2


def simulated(seed, phi, theta, size):
    rng = np.random.default_rng(seed)
    shocks, values = rng.normal(size=size + 200), np.zeros(size + 200)
    for t in range(4, len(values)):
        values[t] = phi @ values[t - 4 : t][::-1] + shocks[t] + theta * shocks[t - 1]
    return values[200:]


MODELS = [
    (np.array([0.5, -0.2, 0.1, 0.05]), 0.4), (np.array([-0.3, 0.0, 0.2, -0.4]), -0.7),
    (np.array([0.9, 0.0, 0.0, 0.0]), 0.0), (np.zeros(4), 0.9),
]


def test_filter_equals_dense_covariance_for_series_of_unequal_length():
    counts = np.array([60, 35, 48, 60])
    changes = np.full((4, 60), 1e6)  # what lies behind a series' end is not read
    for row, (phi, theta) in enumerate(MODELS):
        changes[row, : counts[row]] = simulated(row, phi, theta, counts[row])
    phi, theta = np.stack([m[0] for m in MODELS]), np.array([m[1] for m in MODELS])
    errors, state = likelihood.filter_series(changes, counts, phi, theta)
    found = likelihood.log_likelihood((errors**2).sum(axis=1), counts)
    for row, (n, (f, t)) in enumerate(zip(counts, MODELS)):
        own = changes[row, :n]
        assert found[row] == pytest.approx(dense_likelihood(own, f, t), abs=1e-6)
        matrix = covariance(f, t, n + 1)
        assert state[row, 0] == pytest.approx(matrix[n, :n] @ np.linalg.solve(matrix[:n, :n], own), abs=1e-7)


def _frame(spark, levels):
    rows = [
        (name, date(2010, 1, 1) + timedelta(days=i), float(x))
        for name, values in levels.items() for i, x in enumerate(values)
    ]
    return spark.createDataFrame(rows, "series string, Date date, Sales double").repartition(3)


def test_fits_climb_to_a_maximum(spark):
    levels = {f"s{i}": 1000 * np.cumsum(simulated(10 + i, *m, 140)) for i, m in enumerate(MODELS)}
    found = {r["series"]: r for r in likelihood.fit_series(_frame(spark, levels)).collect()}
    assert set(found) == set(levels)
    for name, row in found.items():
        changes = np.diff(levels[name])
        beta = np.array(row["beta"])
        assert row["n"] == 139 and row["log_likelihood"] >= row["start_likelihood"] - 1e-9
        best = dense_likelihood(changes, beta[:4], beta[4])
        assert row["log_likelihood"] == pytest.approx(best, rel=1e-7)
        for i in range(5):
            for step in (-0.02, 0.02):
                near = beta + np.eye(5)[i] * step
                if likelihood.admissible(near[None, :4], near[None, 4])[0]:
                    assert dense_likelihood(changes, near[:4], near[4]) <= best + 1e-4
    assert found["s0"]["beta"][0] + found["s0"]["beta"][4] == pytest.approx(0.9, abs=0.4)


def test_short_constant_and_missing_series_keep_their_level(spark):
    frame = _frame(spark, {"short": [5, 6, 7], "flat": [3.0] * 60, "one": [4.0]})
    found = likelihood.likelihood_forecast(frame, steps=2).collect()
    assert sorted((r["series"], r["PredictedSales"]) for r in found) == [
        ("flat", 3.0), ("flat", 3.0), ("one", 4.0), ("one", 4.0), ("short", 7.0), ("short", 7.0),
    ]
    assert {r["Date"] for r in found if r["series"] == "short"} == {date(2010, 1, 4), date(2010, 1, 5)}
    assert all(r["log_likelihood"] is None for r in likelihood.fit_series(frame).collect())
    assert likelihood.fit_series(frame.limit(0)).count() == 0


def test_registered_queries_on_the_smallest_tables(spark):
    rows = registry.QUERIES["arima_likelihood"](spark, FOLDER).collect()
    fitted = [r for r in rows if r["log_likelihood"] is not None]
    assert fitted and all(r["log_likelihood"] >= r["start_likelihood"] - 1e-9 for r in fitted)
    names = ["forecast_series", "forecast_series_likelihood"]
    plain, exact = ({(r["series"], r["Date"]) for r in registry.QUERIES[n](spark, FOLDER).collect()} for n in names)
    assert plain == exact
    for name in ("forecast_metrics_likelihood", "backtest_metrics_likelihood"):
        assert registry.QUERIES[name](spark, FOLDER).count() == 1
    assert forecast.series_shocks(_frame(spark, {"a": [1, 2, 3]})).count() == 3
