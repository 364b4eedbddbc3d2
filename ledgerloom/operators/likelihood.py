"""ARIMA(p, 1, 1) by exact Gaussian likelihood, for many daily series at once.

The differences of a series follow a stationary ARMA(p, 1) process, whose state
space form a Kalman filter runs through from the stationary distribution of the
state. The filter's scaled errors are residuals whose sum of squares falls as the
likelihood rises, so damped Gauss-Newton steps climb it from the two-stage
estimates; no step is taken that lowers it.

A series is one row, its days in order, which the calendar bounds. A task filters
all series of a slice side by side, so a day costs a few array operations however
many series there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.forecast import normal_sums, series_shocks, solve_series
from ledgerloom.operators.timeseries import SERIES

SLICE = 128  # series filtered side by side
EDGE = 0.999  # largest modulus of an autoregressive root, and of the moving average
STEADY = 1e-13
MOST_STEPS = 60


def transition(phi: np.ndarray) -> np.ndarray:
    """The companion matrix of each row of autoregressive coefficients, at least 2 x 2."""
    size = max(2, phi.shape[1])
    matrix = np.zeros((len(phi), size, size))
    matrix[:, : phi.shape[1], 0] = phi
    matrix[:, np.arange(size - 1), np.arange(1, size)] = 1
    return matrix


def admissible(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Whether each model is stationary and invertible, with a little room."""
    roots = np.abs(np.linalg.eigvals(transition(phi))).max(axis=1)
    return (roots <= EDGE) & (np.abs(theta) <= EDGE)


def filter_series(
    changes: np.ndarray, counts: np.ndarray, phi: np.ndarray, theta: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(scaled errors, state after the last day) of each row's changes under its own model.

    Rows have ``counts`` changes and anything behind them. With S the sum of
    squared errors and n the count, the largest log-likelihood over the
    innovations' variance is -n/2 (log(2 pi S / n) + 1).
    """
    move = transition(phi)
    models, size = move.shape[:2]
    noise = np.zeros((models, size))
    noise[:, 0], noise[:, 1] = 1, theta
    added = noise[:, :, None] * noise[:, None, :]
    twice = np.einsum("kij,klm->kiljm", move, move).reshape(models, size**2, size**2)
    spread = np.linalg.solve(np.eye(size**2) - twice, added.reshape(models, size**2, 1)).reshape(added.shape)
    state = np.zeros((models, size))
    errors = np.zeros(changes.shape)
    logs = np.zeros(models)
    steady = False
    least = counts.min() if models else 0
    for day in range(changes.shape[1]):
        if not steady:
            variance = spread[:, 0, 0]
            gain = (move @ spread[:, :, :1])[:, :, 0] / variance[:, None]
            root = np.sqrt(variance)
            after = move @ spread @ move.transpose(0, 2, 1) + added
            after -= gain[:, :, None] * gain[:, None, :] * variance[:, None, None]
            steady = np.abs(after - spread).max(initial=0) < STEADY
            spread = after
            logs += np.where(day < counts, np.log(variance), 0)
        elif day < least:
            logs += np.log(variance)
        else:
            logs += np.where(day < counts, np.log(variance), 0)
        error = changes[:, day] - state[:, 0]
        moved = gain * error[:, None]
        moved[:, : phi.shape[1]] += phi * state[:, :1]
        moved[:, :-1] += state[:, 1:]
        if day < least:
            errors[:, day], state = error / root, moved
        else:
            running = day < counts
            errors[running, day] = (error / root)[running]
            state[running] = moved[running]
    return errors * np.exp(logs / (2 * np.maximum(counts, 1)))[:, None], state


def log_likelihood(squares: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest over the innovations' variance."""
    return -counts / 2 * (np.log(2 * np.pi * squares / counts) + 1)


def inside(start: np.ndarray) -> np.ndarray:
    """Coefficients (phi..., theta) drawn inwards until each model is admissible."""
    inner = np.array(start, float)
    inner[~np.isfinite(inner).all(axis=1)] = 0
    order = np.arange(1, inner.shape[1])
    inner[:, -1] = np.clip(inner[:, -1], -0.95, 0.95)
    roots = np.abs(np.linalg.eigvals(transition(inner[:, :-1]))).max(axis=1)
    shrink = np.where(roots > 0.98, 0.98 / np.maximum(roots, 1e-9), 1.0)
    inner[:, :-1] *= shrink[:, None] ** order  # scales every root alike
    return inner


def climb(changes: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Coefficients (phi..., theta) of each row that raise its likelihood from an admissible start."""
    best = start.copy()
    rows, width = best.shape
    damping = np.full(rows, 1e-3)
    open_ = np.ones(rows, bool)
    errors, _ = filter_series(changes, counts, best[:, :-1], best[:, -1])
    value = (errors**2).sum(axis=1)
    for _ in range(MOST_STEPS):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        # Steps towards zero stay admissible.
        step = np.where(best[at] > 0, -1e-6, 1e-6)
        nudged = np.repeat(best[at], width, axis=0)
        nudged[np.arange(len(nudged)), np.tile(np.arange(width), len(at))] += step.ravel()
        moved, _ = filter_series(
            np.repeat(changes[at], width, axis=0), np.repeat(counts[at], width), nudged[:, :-1], nudged[:, -1]
        )
        slope = (moved.reshape(len(at), width, -1) - errors[at][:, None, :]) / step[:, :, None]
        square = slope @ slope.transpose(0, 2, 1)
        lean = np.einsum("kwn,kn->kw", slope, errors[at])
        heavier = square + np.eye(width) * (
            damping[at][:, None, None] * np.einsum("kii->ki", square)[:, None, :] + 1e-12 * value[at][:, None, None]
        )
        trial = best[at] - np.linalg.solve(heavier, lean[:, :, None])[:, :, 0]
        trial[:, -1] = np.clip(trial[:, -1], -EDGE, EDGE)
        usable = np.isfinite(trial).all(axis=1)
        usable[usable] = admissible(trial[usable, :-1], trial[usable, -1])
        trial[~usable] = best[at][~usable]
        tried, _ = filter_series(changes[at], counts[at], trial[:, :-1], trial[:, -1])
        reached = (tried**2).sum(axis=1)
        better = usable & (reached < value[at])
        gain = np.where(better, 1 - reached / value[at], 0)
        kept = at[better]
        best[kept], errors[kept], value[kept] = trial[better], tried[better], reached[better]
        damping[at] = np.where(better, np.maximum(damping[at] / 10, 1e-9), damping[at] * 10)
        open_[at] = np.where(better, gain > 1e-9, damping[at] < 1e4)
    return best


def _fit_slice(sales: list[np.ndarray], betas: np.ndarray, steps: int) -> dict[str, list]:
    """Fits and paths of a slice of series; a series too short or without change keeps its last level."""
    out = {"n": [], "beta": [], "sigma2": [], "start_likelihood": [], "log_likelihood": [], "path": []}
    width = betas.shape[1]
    counts = np.array([max(0, len(x) - 1) for x in sales])
    changes = np.zeros((len(sales), max(1, counts.max(initial=0))))
    for row, levels in enumerate(sales):
        changes[row, : counts[row]] = np.diff(levels)
    fits = (counts > 2 * width) & (changes != 0).any(axis=1)
    # Every series in its own unit, so that one tolerance suits all.
    unit = np.where(fits, np.sqrt((changes**2).sum(axis=1) / np.maximum(counts, 1)), 1.0)
    scaled = changes / unit[:, None]
    start = inside(np.where(fits[:, None], betas, 0.0))
    best = start.copy()
    best[fits] = climb(scaled[fits], counts[fits], start[fits])
    first, _ = filter_series(scaled, counts, start[:, :-1], start[:, -1])
    errors, state = filter_series(scaled, counts, best[:, :-1], best[:, -1])
    move = transition(best[:, :-1])
    path, level = [], np.array([x[-1] if len(x) else np.nan for x in sales])
    for _ in range(steps):
        level = level + np.where(fits, state[:, 0] * unit, 0.0)
        path.append(level)
        state = (move @ state[:, :, None])[:, :, 0]
    total = np.maximum(counts, 1)
    with np.errstate(divide="ignore"):
        before, after = (log_likelihood((e**2).sum(axis=1), total) - total * np.log(unit) for e in (first, errors))
    sizes = (errors**2).sum(axis=1) / total * unit**2
    for row, fitted in enumerate(fits):
        out["n"].append(int(counts[row]))
        out["beta"].append(best[row].tolist())
        for name, values in (("sigma2", sizes), ("start_likelihood", before), ("log_likelihood", after)):
            out[name].append(float(values[row]) if fitted else None)
        out["path"].append([float(x[row]) for x in path])
    return out


def fit_series(train: DataFrame, steps: int = 7, p: int = 4, long_order: int = 8) -> DataFrame:
    """One row per gap-free series.

    (series, Date, n, beta, sigma2, start_likelihood, log_likelihood, path): the last
    day, the number of changes, p autoregressive coefficients and the moving average,
    the innovations' scale with the likelihood's determinant in it, the exact
    log-likelihood at the two-stage estimates and at the fit, and the next days'
    levels. Scale and likelihoods are null where a series is too short or constant.
    """
    lags = [f"d{i}" for i in range(1, p + 1)]
    sums = normal_sums(series_shocks(train, long_order), "d0", [*lags, "e1"])
    days = F.array_sort(F.collect_list(F.struct("Date", "Sales")))
    # A series' days are as many as the calendar's.
    rows = train.groupBy(SERIES).agg(days.alias("days")).select(
        SERIES, F.element_at("days", -1)["Date"].alias("Date"), F.col("days")["Sales"].alias("sales")
    )
    kind = train.schema[SERIES].dataType.simpleString()

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                part = batch.iloc[begin : begin + SLICE]
                sales = [np.asarray(x, float) for x in part["sales"]]
                found = _fit_slice(sales, np.stack([np.asarray(x, float) for x in part["beta"]]), steps)
                yield pd.DataFrame({SERIES: part[SERIES].to_numpy(), "Date": part["Date"].to_numpy(), **found})

    return rows.join(solve_series(sums), SERIES).mapInPandas(
        fit,
        f"{SERIES} {kind}, Date date, n bigint, beta array<double>, sigma2 double, "
        "start_likelihood double, log_likelihood double, path array<double>",
    )


def likelihood_forecast(train: DataFrame, steps: int = 7, p: int = 4, long_order: int = 8) -> DataFrame:
    """The next days of each gap-free series: (series, Date, PredictedSales)."""
    return (
        fit_series(train, steps, p, long_order)
        .select(SERIES, "Date", F.posexplode("path").alias("step", "PredictedSales"))
        .select(SERIES, F.date_add("Date", F.col("step") + 1).alias("Date"), "PredictedSales")
    )
