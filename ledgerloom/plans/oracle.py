"""Independent SQL for each registered query, for a second engine to run.

Each text is a chain of common table expressions. ``chain`` pulls in the ones a
statement mentions; nothing here shares logic with the Spark operators except
the adapter views, which are inputs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from ledgerloom.plans.registry import (
    BACKTEST_END,
    BACKTEST_START,
    DASHBOARD_COUNTRY,
    DASHBOARD_MONTH,
    DENSITY_EPS,
    FREQUENCY_LIMIT,
    HISTOGRAM_BINS,
    MONETARY_LIMIT,
    STAGES,
)
from ledgerloom.sources.adapters import VIEWS
from ledgerloom.sources.schemas import TRANSACTION_DESCRIPTIONS

DAY_US = "86400000000.0"
RFM = ["Recency", "Frequency", "Monetary"]
EXTENDED = RFM + ["AvgPurchaseValue", "ProductDiversity", "AvgDaysBetweenTransactions"]


def _adapter(name: str) -> str:
    text, names = VIEWS[name]
    text = text.replace("{MINUTES}", "to_minutes(CAST(o.o_orderkey % 1440 AS INT))")
    for table in names:
        text = text.replace("{" + table + "}", table)
    return text


def _days(start: str, end: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / {DAY_US}) AS BIGINT)"


CTES: dict[str, str] = {name: _adapter(name) for name in VIEWS}
CTES |= {
    "clean": """
        SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice,
               CAST(CAST(CustomerID AS BIGINT) AS VARCHAR) AS CustomerID, Country,
               CAST(Quantity * UnitPrice AS DECIMAL(18,4)) AS TotalPrice
        FROM transactions
        WHERE CustomerID IS NOT NULL AND InvoiceNo IS NOT NULL AND StockCode IS NOT NULL
          AND InvoiceDate IS NOT NULL AND NOT starts_with(InvoiceNo, 'C')
          AND Quantity > 0 AND UnitPrice > 0""",
    "snap": "SELECT max(InvoiceDate) + INTERVAL 1 DAY AS moment FROM clean",
    "base": f"""
        SELECT CustomerID, {_days("max(InvoiceDate)", "(SELECT moment FROM snap)")} AS Recency,
               count(DISTINCT InvoiceNo) AS Frequency,
               CAST(sum(TotalPrice) AS DOUBLE) AS Monetary
        FROM clean GROUP BY CustomerID""",
    "invoice": """
        SELECT CustomerID, InvoiceNo, min(InvoiceDate) AS InvoiceDate
        FROM clean GROUP BY CustomerID, InvoiceNo""",
    "gap": f"""
        SELECT CustomerID, InvoiceNo, InvoiceDate,
               {_days("lag(InvoiceDate) OVER w", "InvoiceDate")} AS DaysBetweenTransactions
        FROM invoice WINDOW w AS (PARTITION BY CustomerID ORDER BY InvoiceDate, InvoiceNo)""",
    "gap_mean": """
        SELECT CustomerID,
               coalesce(avg(DaysBetweenTransactions), 0.0) AS AvgDaysBetweenTransactions
        FROM gap GROUP BY CustomerID""",
    "diversity": """
        SELECT CustomerID, count(DISTINCT StockCode) AS ProductDiversity
        FROM clean GROUP BY CustomerID""",
    "feat": """
        SELECT base.*, Monetary / Frequency AS AvgPurchaseValue, ProductDiversity,
               AvgDaysBetweenTransactions
        FROM base LEFT JOIN diversity USING (CustomerID) LEFT JOIN gap_mean USING (CustomerID)""",
    "day": """
        SELECT 'all' AS series, CAST(InvoiceDate AS DATE) AS Date,
               CAST(sum(TotalPrice) AS DOUBLE) AS Sales
        FROM clean GROUP BY ALL""",
    "filled": """
        SELECT 'all' AS series, CAST(d AS DATE) AS Date, coalesce(Sales, 0.0) AS Sales
        FROM (SELECT unnest(generate_series((SELECT min(Date) FROM day),
                                            (SELECT max(Date) FROM day), INTERVAL 1 DAY)) AS d)
        LEFT JOIN day ON day.Date = CAST(d AS DATE)""",
    "country_day": """
        SELECT Country AS series, CAST(InvoiceDate AS DATE) AS Date,
               CAST(sum(TotalPrice) AS DOUBLE) AS Sales
        FROM clean GROUP BY ALL""",
    "country_filled": """
        SELECT s.series, CAST(s.d AS DATE) AS Date, coalesce(c.Sales, 0.0) AS Sales
        FROM (SELECT series, unnest(generate_series(min(Date), max(Date), INTERVAL 1 DAY)) AS d
              FROM country_day GROUP BY series) s
        LEFT JOIN country_day c ON c.series = s.series AND c.Date = CAST(s.d AS DATE)""",
    "country_parts": """
        SELECT *, row_number() OVER (PARTITION BY series ORDER BY Date DESC) <= 7 AS is_test
        FROM country_filled""",
    "all_parts": """
        SELECT *, row_number() OVER (PARTITION BY series ORDER BY Date DESC) <= 7 AS is_test
        FROM filled""",
    "window_parts": f"""
        SELECT *, Date >= DATE '{BACKTEST_START}' AS is_test
        FROM filled WHERE Date <= DATE '{BACKTEST_END}'""",
    "digests": """
        SELECT *, row_number() OVER (ORDER BY md5(CustomerID))
                  <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test
        FROM feat""",
    "capped_digests": f"""
        SELECT *, row_number() OVER (ORDER BY md5(CustomerID))
                  <= ceil(count(*) OVER () * 0.2::DOUBLE) AS is_test
        FROM base WHERE Frequency <= {FREQUENCY_LIMIT} AND Monetary <= {MONETARY_LIMIT}""",
    "scaled": f"""
        SELECT CustomerID, {", ".join(
            f"(l{i} - avg(l{i}) OVER ()) / stddev_pop(l{i}) OVER () AS x{i}" for i in range(3))}
        FROM (SELECT CustomerID, {", ".join(f"ln(1 + {n}::DOUBLE) AS l{i}" for i, n in enumerate(RFM))}
              FROM base)""",
}


def _segment(parts: int, source: str) -> str:
    cuts = " + ".join(
        f"CAST(Monetary < (SELECT quantile_cont(Monetary, {i / parts!r}::DOUBLE) FROM {source}) AS BIGINT)"
        for i in range(1, parts)
    )
    return f"SELECT *, {cuts} AS segment FROM {source}"


CTES |= {
    "seg2": _segment(2, "base"),
    "seg3": _segment(3, "base"),
    "seg4": _segment(4, "base"),
    "feat4": _segment(4, "feat"),
    "items": """
        SELECT segment, InvoiceNo, Description AS item
        FROM clean JOIN seg3 USING (CustomerID) WHERE Description IS NOT NULL
        GROUP BY ALL HAVING sum(Quantity) > 0""",
    "items_deep": """
        SELECT DISTINCT segment, InvoiceNo, 'Group#' || (substr(item, 7)::INT % 6) AS item FROM items""",
}


def _mining(suffix: str) -> dict[str, str]:
    """Item sets of any size, by all subsets of each basket's frequent items, and their rules."""
    t = suffix
    return {
        f"sizes{t}": f"""
            SELECT segment, count(DISTINCT InvoiceNo) AS n FROM items{t}
            GROUP BY segment HAVING count(DISTINCT InvoiceNo) >= 10""",
        f"ones{t}": f"""
            SELECT segment, item, any_value(n) AS n FROM items{t} JOIN sizes{t} USING (segment)
            GROUP BY segment, item HAVING count(*) * 100 >= 2 * any_value(n)""",
        f"lists{t}": f"""
            SELECT segment, InvoiceNo, list_sort(list(item)) AS basket, any_value(n) AS n
            FROM items{t} JOIN ones{t} USING (segment, item) GROUP BY segment, InvoiceNo""",
        f"subsets{t}": f"""
            SELECT segment, n, list_filter(basket, lambda x, i: (mask // (1 << (i - 1))) % 2 = 1) AS items
            FROM (SELECT *, unnest(range(1, 1 << len(basket))) AS mask FROM lists{t})""",
        f"sets{t}": f"""
            SELECT segment, items, count(*) AS freq, any_value(n) AS n FROM subsets{t}
            GROUP BY segment, items HAVING count(*) * 100 >= 2 * any_value(n)""",
        f"splits{t}": f"""
            SELECT s.segment, a.items AS ante, c.items AS cons, s.freq::DOUBLE AS f, s.n::DOUBLE AS n,
                   a.freq::DOUBLE AS fa, c.freq::DOUBLE AS fc
            FROM sets{t} s
            JOIN sets{t} a ON a.segment = s.segment AND len(a.items) < len(s.items)
                 AND list_has_all(s.items, a.items)
            JOIN sets{t} c ON c.segment = s.segment AND len(c.items) = len(s.items) - len(a.items)
                 AND list_has_all(s.items, c.items) AND NOT list_has_any(a.items, c.items)""",
        f"rule{t}": f"""
            SELECT segment, array_to_string(ante, ', ') AS antecedents,
                   array_to_string(cons, ', ') AS consequents, len(ante) AS a_size, len(cons) AS c_size,
                   fa / n AS antecedent_support, fc / n AS consequent_support, f / n AS support,
                   f / fa AS confidence, f * n / (fa * fc) AS lift,
                   (f * n - fa * fc) / (n * n) AS leverage,
                   CASE WHEN fa > f THEN (n - fc) * fa / (n * (fa - f)) END AS conviction
            FROM splits{t} WHERE f * n >= fa * fc""",
        f"unmirrored{t}": f"""
            SELECT * FROM rule{t}
            WHERE a_size > c_size OR (a_size = c_size AND antecedents < consequents)""",
    }


CTES |= _mining("") | _mining("_deep")


def chain(statement: str) -> str:
    """The statement behind the expressions it needs, dependencies first."""
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in CTES and name not in seen:
                seen.add(name)
                need(CTES[name])
                order.append(name)

    need(statement)
    heads = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    return f"WITH RECURSIVE {heads}\n{statement}" if heads else statement


def even(expression: str, digits: int) -> str:
    """Round half to even."""
    return f"round_even(CAST({expression} AS DOUBLE), {digits})"


def up(expression: str, digits: int) -> str:
    """Round half away from zero, free of binary noise."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _summary(source: str, label: str, columns: Sequence[str]) -> str:
    means = ", ".join(
        f"{even(f'CAST(sum(CAST({c} AS DECIMAL(28,10))) AS DOUBLE) / count(*)', 2)} AS {c}" for c in columns
    )
    share = even("count(*)::DOUBLE / sum(count(*)) OVER () * 100", 2)
    return (
        f"SELECT {label}, {means}, count(*) AS CustomerCount, {share} AS Percentage "
        f"FROM {source} GROUP BY {label}"
    )


def _statistics(source: str, columns: Sequence[str]) -> str:
    def one(name: str) -> str:
        value = f"{name}::DOUBLE"
        parts = [
            f"{even(call, 2)} AS {alias}"
            for alias, call in {
                "mean": f"avg({value})",
                "std": f"stddev_samp({value})",
                "min": f"min({value})",
                "q25": f"quantile_cont({value}, 0.25)",
                "q50": f"quantile_cont({value}, 0.5)",
                "q75": f"quantile_cont({value}, 0.75)",
                "max": f"max({value})",
            }.items()
        ]
        return f"SELECT '{name}' AS feature, count({name}) AS count, {', '.join(parts)} FROM {source}"

    return " UNION ALL ".join(one(name) for name in columns)


def _histogram(name: str, bins: int) -> str:
    index = f"coalesce(least(CAST(floor(({name} - lo) / nullif(w, 0)) AS BIGINT), {bins - 1}), 0)"
    return f"""
        SELECT '{name}' AS feature, bin, {even("any_value(lo) + any_value(w) * bin", 4)} AS bin_start,
               count(*) AS count
        FROM (SELECT {index} AS bin, lo, w
              FROM (SELECT {name}::DOUBLE AS {name}, min({name}::DOUBLE) OVER () AS lo,
                           (max({name}::DOUBLE) OVER () - min({name}::DOUBLE) OVER ()) / {bins}.0::DOUBLE AS w
                    FROM feat))
        GROUP BY bin"""


KPIS = """CAST(sum(TotalPrice) AS DOUBLE) AS revenue, count(DISTINCT InvoiceNo) AS orders,
          count(DISTINCT CustomerID) AS customers, CAST(sum(Quantity) AS BIGINT) AS units,
          CAST(sum(TotalPrice) AS DOUBLE) / count(DISTINCT InvoiceNo) AS aov"""
STAMP = "strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate"
TX = (
    f"InvoiceNo, StockCode, Description, CAST(Quantity AS BIGINT) AS Quantity, {STAMP}, "
    "CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country"
)
DATE = "strftime(Date, '%Y-%m-%d') AS Date"


def _attrition(dimension: str, value: str) -> str:
    rate = up("100.0::DOUBLE * count(*) FILTER (attrition) / count(*)", 2)
    return (
        f"SELECT {dimension} AS dimension, {value} AS value, count(*) AS employees, "
        f"count(*) FILTER (attrition) AS departures, {rate} AS attrition_pct FROM employees GROUP BY ALL"
    )


def _won(value: str) -> str:
    return up(f"sum(CAST({value} AS DECIMAL(18,4)))", 0)


# --- least squares by successive orthogonalisation ---------------------------


def _ols(name: str, source: str, columns: Sequence[str], target: str, fit: str, by: str, key: str) -> str:
    """Register expressions that end in ``<name>_fit`` with a ``predicted`` column.

    Each step removes from the remaining columns their projection on the
    current one, with coefficients from the rows that satisfy ``fit``, per ``by``.
    """
    names = [f"p{i}" for i in range(len(columns))]
    picks = ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for c, n in zip(columns, names))
    CTES[f"{name}_0"] = (
        f"SELECT {key}, {by} AS grp, ({fit}) AS fit, CAST({target} AS DOUBLE) AS actual, "
        f"CAST({target} AS DOUBLE) AS y, {picks} FROM {source}"
    )
    for step, pivot in enumerate(names):
        rest = [*names[step + 1 :], "y"]
        slope = ", ".join(
            f"{r} - {pivot} * coalesce(sum({r} * {pivot}) FILTER (fit) OVER g "
            f"/ nullif(sum({pivot} * {pivot}) FILTER (fit) OVER g, 0), 0) AS {r}"
            for r in rest
        )
        carried = "".join(f", {n}" for n in names[: step + 1])
        CTES[f"{name}_{step + 1}"] = (
            f"SELECT {key}, grp, fit, actual{carried}, {slope} FROM {name}_{step} "
            "WINDOW g AS (PARTITION BY grp)"
        )
    CTES[f"{name}_fit"] = (
        f"SELECT {key}, fit, actual, actual - y AS predicted FROM {name}_{len(names)}"
    )
    return f"{name}_fit"


def _spend(name: str, source: str, columns: Sequence[str]) -> str:
    return _ols(name, source, ["1", *columns], "Monetary", "NOT is_test", "0", "CustomerID")


_spend("ols2", "digests", RFM[:2])
_spend("ols4", "digests", ["Recency", "Frequency", "ProductDiversity", "AvgDaysBetweenTransactions"])
_spend("olsc", "capped_digests", RFM[:2])


def _fit_metrics(model: str, features: str, source: str) -> str:
    error = "(actual - predicted)"
    share = f"abs{error} / greatest(abs(actual), 2.220446049250313e-16)"
    return f"""
        SELECT '{model}' AS Model, '{features}' AS Features, 'Monetary' AS Target,
               {even(f"avg(abs{error})", 2)} AS MAE, {even(f"sqrt(avg({error} * {error}))", 2)} AS RMSE,
               {even(f"avg({share}) * 100", 2)} AS MAPE,
               {even(f"1 - sum({error} * {error}) / (var_pop(actual) * count(*))", 4)} AS R2
        FROM {source} WHERE NOT fit"""


CTES["ols_scale"] = """
    SELECT avg(Recency::DOUBLE) AS m1, stddev_pop(Recency::DOUBLE) AS s1,
           avg(Frequency::DOUBLE) AS m2, stddev_pop(Frequency::DOUBLE) AS s2
    FROM digests WHERE NOT is_test"""
CTES["ols_sums"] = """
    SELECT count(*)::DOUBLE AS n, sum(z1 * z2) AS s12, sum(z1 * y) AS s1y, sum(z2 * y) AS s2y, avg(y) AS my
    FROM (SELECT (Recency - m1) / s1 AS z1, (Frequency - m2) / s2 AS z2, Monetary AS y
          FROM digests JOIN ols_scale ON true WHERE NOT is_test)"""

# --- forecasts ---------------------------------------------------------------


def _arima(name: str, parts: str, p: int = 4, long_order: int = 8, steps: int = 7) -> str:
    """Register expressions that end in ``<name>_path``: (series, Date, PredictedSales)."""
    CTES[f"{name}_diff"] = (
        f"SELECT series, Date, Sales, Sales - lag(Sales) OVER (PARTITION BY series ORDER BY Date) AS d0 "
        f"FROM {parts} WHERE NOT is_test"
    )
    lags = ", ".join(
        f"lag(d0, {i}) OVER (PARTITION BY series ORDER BY Date) AS d{i}" for i in range(1, long_order + 1)
    )
    CTES[f"{name}_lags"] = f"SELECT *, {lags} FROM {name}_diff"
    CTES[f"{name}_full"] = f"SELECT * FROM {name}_lags WHERE d{long_order} IS NOT NULL"
    first = _ols(
        f"{name}_a", f"{name}_full", [f"d{i}" for i in range(1, long_order + 1)], "d0", "true", "series",
        "series, Date",
    )
    CTES[f"{name}_shock"] = f"""
        SELECT l.*, f.actual - f.predicted AS e0,
               lag(f.actual - f.predicted) OVER (PARTITION BY l.series ORDER BY l.Date) AS e1
        FROM {name}_lags l LEFT JOIN {first} f ON f.series = l.series AND f.Date = l.Date"""
    # The prediction for a unit vector is one coefficient: append one such row
    # per predictor, outside the fit.
    slots = [f"d{i}" for i in range(1, p + 1)] + ["e1"]
    probes = " UNION ALL ".join(
        f"SELECT DISTINCT series, DATE '0001-01-01' + {i} AS Date, 0.0::DOUBLE AS d0, "
        + ", ".join(f"{1.0 if i == j else 0.0}::DOUBLE AS {slot}" for j, slot in enumerate(slots))
        + f", true AS probe FROM {name}_diff"
        for i in range(len(slots))
    )
    CTES[f"{name}_rows"] = (
        f"SELECT series, Date, d0, {', '.join(slots)}, false AS probe FROM {name}_shock "
        f"WHERE e1 IS NOT NULL UNION ALL {probes}"
    )
    second = _ols(f"{name}_b", f"{name}_rows", slots, "d0", "NOT probe", "series", "series, Date")
    coefficients = ", ".join(
        f"max(predicted) FILTER (Date = DATE '0001-01-01' + {i}) AS b{i}" for i in range(len(slots))
    )
    CTES[f"{name}_beta"] = f"SELECT series, {coefficients} FROM {second} WHERE NOT fit GROUP BY series"
    CTES[f"{name}_last"] = (
        f"SELECT * FROM {name}_shock QUALIFY row_number() OVER (PARTITION BY series ORDER BY Date DESC) = 1"
    )
    ar = " + ".join(f"b{i} * c{i}" for i in range(p))
    shift = ", ".join(f"c{i - 1}" for i in range(1, p))
    CTES[f"{name}_path"] = f"""
        SELECT l.series, l.Date, 0 AS h, l.Sales AS PredictedSales, l.e0 AS shock,
               {", ".join(f"l.d{i} AS c{i}" for i in range(p))}
        FROM {name}_last l
        UNION ALL
        SELECT series, Date + 1, h + 1, PredictedSales + ({ar} + b{p} * shock), 0.0::DOUBLE,
               {ar} + b{p} * shock, {shift}
        FROM {name}_path JOIN {name}_beta USING (series) WHERE h < {steps}"""
    return f"{name}_path"


_arima("arima_country", "country_parts")
_arima("arima_all", "all_parts")
_arima("arima_window", "window_parts")


def _compare(parts: str, path: str) -> str:
    return f"""
        SELECT t.series, t.Date, {even("t.Sales", 2)} AS ActualSales,
               {even("p.PredictedSales", 2)} AS PredictedSales
        FROM {parts} t JOIN {path} p ON p.series = t.series AND p.Date = t.Date WHERE t.is_test"""


def _forecast_metrics(comparison: str, model: str) -> str:
    error = "(ActualSales - PredictedSales)"
    return f"""
        SELECT series, '{model}' AS Model, '7 Days' AS ForecastHorizon,
               {even(f"avg(abs{error})", 2)} AS MAE, {even(f"sqrt(avg({error} * {error}))", 2)} AS RMSE,
               {even(f"avg(abs{error} / abs(ActualSales)) FILTER (ActualSales <> 0) * 100", 2)} AS MAPE
        FROM ({comparison}) GROUP BY series"""


CTES["naive"] = """
    SELECT series, max(Date) + CAST(h AS INT) AS Date, arg_max(Sales, Date) AS PredictedSales
    FROM country_parts, range(1, 8) r(h) WHERE NOT is_test GROUP BY series, h"""
CTES["design"] = """
    SELECT *, lag(d0, 1) OVER w AS d1, lag(d0, 2) OVER w AS d2, lag(d0, 3) OVER w AS d3, lag(d0, 4) OVER w AS d4
    FROM (SELECT *, Sales - lag(Sales) OVER (PARTITION BY series ORDER BY Date) AS d0
          FROM country_parts WHERE NOT is_test)
    WINDOW w AS (PARTITION BY series ORDER BY Date)"""
DESIGN_SUMS = ", ".join(
    f"{even(f'sum(d{i} * d{j}) FILTER (d4 IS NOT NULL) / 1e6', 2)} AS d{i}d{j}"
    for i in range(5)
    for j in range(max(i, 1), 5)
)

# --- clusters ----------------------------------------------------------------

for _parts in (2, 3, 4):
    CTES[f"space{_parts}"] = f"SELECT s.*, segment FROM scaled s JOIN seg{_parts} USING (CustomerID)"


def _gap(left: str, right: str, axes: int) -> str:
    return " + ".join(f"({left}.x{i} - {right}.x{i}) ** 2" for i in range(axes))


def _distances(name: str, source: str, axes: int) -> None:
    CTES[name] = f"""
    SELECT s.CustomerID AS a, p.CustomerID AS b, {_gap("s", "p", axes)} AS d
    FROM {source} s JOIN {source} p ON true"""


_distances("distances", "scaled", 3)


def _silhouette(labels: str, distances: str = "distances") -> str:
    """Mean silhouette under a labelling given as a table (CustomerID, segment)."""
    return f"""
        SELECT avg(CASE WHEN own_size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s
        FROM (SELECT a.a AS id, max(CASE WHEN a.own = a.seg THEN a.n END) AS own_size,
                     max(CASE WHEN a.own = a.seg THEN a.total / nullif(a.n - 1, 0) END) AS a,
                     min(CASE WHEN a.own <> a.seg THEN a.total / a.n END) AS b
              FROM (SELECT d.a, l.segment AS own, r.segment AS seg, count(*) AS n, sum(d.d) AS total
                    FROM {distances} d JOIN {labels} l ON l.CustomerID = d.a
                    JOIN {labels} r ON r.CustomerID = d.b GROUP BY ALL) a
              GROUP BY a.a)"""


CTES["drawn"] = "SELECT CustomerID FROM scaled ORDER BY md5(CustomerID) LIMIT 1000"


def _euclidean(labels: str, name: str) -> str:
    """The mean Euclidean silhouette of the drawn points, and its standard error."""
    return f"""
        SELECT '{name}' AS label_column, count(*) AS draws, {even("avg(s)", 4)} AS silhouette,
               {even("stddev_samp(s) / sqrt(count(*)) * sqrt(1 - count(*)::DOUBLE / any_value(total))", 4)} AS standard_error
        FROM (SELECT CASE WHEN own_size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s, total
              FROM (SELECT id, sum(n) AS total, max(CASE WHEN own = seg THEN n END) AS own_size,
                           max(CASE WHEN own = seg THEN far / nullif(n - 1, 0) END) AS a,
                           min(CASE WHEN own <> seg THEN far / n END) AS b
                    FROM (SELECT d.a AS id, l.segment AS own, r.segment AS seg, count(*) AS n, sum(sqrt(d.d)) AS far
                          FROM distances d JOIN drawn ON drawn.CustomerID = d.a JOIN {labels} l ON l.CustomerID = d.a
                          JOIN {labels} r ON r.CustomerID = d.b GROUP BY ALL)
                    GROUP BY id))"""


def _davies_bouldin(labels: str, axes: int = 3) -> str:
    return f"""
        SELECT avg(worst) AS db FROM (
            SELECT i.segment, max((i.s + j.s) / sqrt({_gap("i", "j", axes)})) AS worst
            FROM {labels}_spread i JOIN {labels}_spread j ON i.segment <> j.segment GROUP BY i.segment)"""


def _spread(labels: str, axes: int = 3) -> None:
    """Each cluster's centre and the mean distance to it."""
    centre = ", ".join(f"avg(x{i}) OVER g AS c{i}" for i in range(axes))
    same = ", ".join(f"any_value(c{i}) AS x{i}" for i in range(axes))
    apart = " + ".join(f"(x{i} - c{i}) ** 2" for i in range(axes))
    CTES[f"{labels}_spread"] = f"""
        SELECT segment, {same}, avg(sqrt({apart})) AS s
        FROM (SELECT *, {centre} FROM {labels} WINDOW g AS (PARTITION BY segment))
        GROUP BY segment"""


for _parts in (2, 3, 4):
    _spread(f"space{_parts}")


def _scale(name: str, source: str, columns: Sequence[str]) -> None:
    """Standardised logarithms x0, x1, ... of columns."""
    cells = ", ".join(f"(l{i} - avg(l{i}) OVER ()) / stddev_pop(l{i}) OVER () AS x{i}" for i in range(len(columns)))
    logs = ", ".join(f"ln(1 + {n}::DOUBLE) AS l{i}" for i, n in enumerate(columns))
    CTES[name] = f"SELECT CustomerID, {cells} FROM (SELECT CustomerID, {logs} FROM {source})"


def _kmeans(name: str, source: str, axes: int, ks: Sequence[int], starts: int = 10, scale: int = 1_000_000) -> None:
    """Rounds of every start of every k until nothing moves; ``<name><k>`` holds (CustomerID, x..., segment)."""
    count = starts * max(ks)
    names = ", ".join(f"q{i}" for i in range(axes))
    CTES[f"{name}_grid"] = f"""
        SELECT CustomerID, {", ".join(f"x{i}, CAST(CAST(round(x{i} * {scale}) AS BIGINT) AS DOUBLE) AS q{i}" for i in range(axes))}
        FROM {source}"""
    CTES[f"{name}_seeds"] = f"""
        SELECT row_number() OVER (ORDER BY d) - 1 AS r, [{names}] AS q
        FROM (SELECT {names}, min(md5(CustomerID)) AS d FROM {name}_grid GROUP BY {names})
        QUALIFY r < {count}"""
    CTES[f"{name}_jobs"] = f"""
        SELECT k, s, (SELECT count(*) FROM {name}_seeds) AS m
        FROM (SELECT unnest([{", ".join(map(str, ks))}]) AS k) JOIN (SELECT unnest(range({starts})) AS s) ON true"""
    CTES[f"{name}_begin"] = f"""
        SELECT k, s, list(q ORDER BY j) AS centres
        FROM (SELECT *, unnest(range(k)) AS j FROM {name}_jobs) JOIN {name}_seeds ON r = (s + {starts} * j) % m
        GROUP BY k, s"""
    gap = " + ".join(f"(q{i} - c[{i + 1}]) * (q{i} - c[{i + 1}])" for i in range(axes))
    near = f"list_transform(centres, lambda c: {gap})"
    sums = ", ".join(f"sum(CAST(q{i} AS HUGEINT)) AS s{i}" for i in range(axes))
    total = "[" + ", ".join(f"CAST(s{i} AS DOUBLE) / n" for i in range(axes)) + "]"
    square = " + ".join(f"s{i} * s{i}" for i in range(axes))
    step = [f"(fresh[j][{i + 1}] - centres[j][{i + 1}])" for i in range(axes)]
    shift = " + ".join(f"{x} * {x}" for x in step)
    CTES[f"{name}_rounds"] = f"""
        SELECT k, s, 0 AS round, centres, true AS moved, 0::HUGEINT AS gain FROM {name}_begin
        UNION ALL
        SELECT k, s, round + 1, fresh, list_sum(list_transform(range(1, k + 1), lambda j: {shift})) > {1e-4 * scale * scale}, gain
        FROM (SELECT k, s, round, centres, gain,
                     list_transform(range(1, k + 1), lambda j: coalesce(found[j], centres[j])) AS fresh
              FROM (SELECT k, s, any_value(round) AS round, any_value(centres) AS centres,
                           map(list(j ORDER BY j), list({total} ORDER BY j)) AS found,
                           CAST(sum(({square}) // n) AS HUGEINT) AS gain
                    FROM (SELECT k, s, j, any_value(round) AS round, any_value(centres) AS centres, count(*) AS n, {sums}
                          FROM (SELECT k, s, round, centres, {names}, list_position({near}, list_min({near})) AS j
                                FROM {name}_rounds JOIN {name}_grid ON moved)
                          GROUP BY k, s, j)
                    GROUP BY k, s))"""
    CTES[f"{name}_best"] = f"""
        SELECT k, centres FROM {name}_rounds WHERE NOT moved
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, s) = 1"""
    for k in ks:
        CTES[f"{name}{k}"] = f"""
            SELECT CustomerID, {", ".join(f"x{i}" for i in range(axes))}, list_position({near}, list_min({near})) AS segment
            FROM {name}_grid JOIN {name}_best ON k = {k}"""
        _spread(f"{name}{k}", axes)


def _sweep(name: str, method: str, axes: int, ks: Sequence[int], distances: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{method}' AS Method, {k}::BIGINT AS Clusters, {even('s', 4)} AS SilhouetteScore, "
        f"{even('db', 4)} AS DaviesBouldinIndex FROM ({_silhouette(f'{name}{k}', distances)}) "
        f"JOIN ({_davies_bouldin(f'{name}{k}', axes)}) ON true"
        for k in ks
    )


def _ordered(name: str, k: int, features: str) -> str:
    """(features, cluster): labels by falling mean of Monetary."""
    return f"""(SELECT f.*, dense_rank() OVER (ORDER BY mean DESC, segment) - 1 AS cluster
        FROM (SELECT f.*, segment, avg(Monetary::DOUBLE) OVER (PARTITION BY segment) AS mean
              FROM {name}{k} JOIN {features} f USING (CustomerID)) f)"""


SWEPT = range(2, 9)
_scale("scaled6", "feat", EXTENDED)
CTES["base_kept"] = """
    SELECT base.* FROM base JOIN (
        SELECT quantile_cont(Monetary, 0.25) AS q1, quantile_cont(Monetary, 0.75) AS q3 FROM base)
    ON Monetary <= q3 + 1.5::DOUBLE * (q3 - q1)"""
_scale("scaled_kept", "base_kept", RFM)
_distances("distances6", "scaled6", len(EXTENDED))
_distances("distances_kept", "scaled_kept", 3)
_kmeans("km", "scaled", 3, SWEPT)
_kmeans("kmx", "scaled6", len(EXTENDED), SWEPT)
_kmeans("kmp", "scaled", 3, (3, 4))
_kmeans("kmpx", "scaled6", len(EXTENDED), (3, 4))
_kmeans("kmf", "scaled_kept", 3, (2,))
CTES["km_scores"] = _sweep("km", "KMeans_RFM", 3, SWEPT, "distances")
CTES["km_win"] = "SELECT Clusters AS won FROM km_scores ORDER BY SilhouetteScore DESC, Clusters LIMIT 1"
for _k in SWEPT:
    CTES[f"km{_k}_ordered"] = f"SELECT {_k}::BIGINT AS Clusters, * FROM {_ordered('km', _k, 'base')} JOIN km_win ON won = {_k}"

CTES |= {
    "placed": f"""
        SELECT CustomerID, {", ".join(f"CAST(floor(x{i} / {DENSITY_EPS}::DOUBLE) AS BIGINT) AS g{i}" for i in range(3))}
        FROM scaled""",
    "grid": "SELECT g0, g1, g2, g0 * 1000000 + g1 * 1000 + g2 AS cell, count(*) AS points FROM placed GROUP BY ALL",
    "adjacent": """
        SELECT a.cell AS cell, b.cell AS near, b.points AS near_points
        FROM grid a JOIN grid b ON abs(a.g0 - b.g0) <= 1 AND abs(a.g1 - b.g1) <= 1 AND abs(a.g2 - b.g2) <= 1""",
    "blocks": """
        SELECT g.cell, g.points, sum(near_points) AS block_points, sum(near_points) >= 5 AS core
        FROM grid g JOIN adjacent USING (cell) GROUP BY g.cell, g.points""",
    "links": """
        SELECT a.cell, a.near FROM adjacent a
        JOIN blocks x ON x.cell = a.cell JOIN blocks y ON y.cell = a.near WHERE x.core AND y.core""",
    "reach": """
        SELECT cell, near FROM links
        UNION
        SELECT r.cell, l.near FROM reach r JOIN links l ON l.cell = r.near""",
    "core_group": "SELECT cell, min(g2 * 1000000000000 + g1 * 1000000 + g0) AS root FROM (SELECT r.cell, g.* EXCLUDE (cell) FROM reach r JOIN grid g ON g.cell = r.near) GROUP BY cell",
    "cell_group": """
        SELECT cell, root FROM core_group
        UNION ALL
        SELECT a.cell, min(c.root) FROM adjacent a JOIN blocks x ON x.cell = a.cell
        JOIN core_group c ON c.cell = a.near WHERE NOT x.core GROUP BY a.cell""",
    "group_label": """
        SELECT root, row_number() OVER (ORDER BY sum(points) DESC, root) - 1 AS cluster
        FROM cell_group JOIN grid USING (cell) GROUP BY root
        HAVING sum(points) >= 0.03::DOUBLE * (SELECT sum(points) FROM grid)""",
    "dense": """
        SELECT p.CustomerID, coalesce(cluster, -1) AS cluster
        FROM placed p JOIN grid USING (g0, g1, g2) LEFT JOIN cell_group USING (cell)
        LEFT JOIN group_label USING (root)""",
    "dense_features": "SELECT * FROM base JOIN dense USING (CustomerID)",
    "dense_kept": "SELECT CustomerID, cluster AS segment FROM dense WHERE cluster >= 0",
    "covariance": "SELECT " + ", ".join(
        f"covar_pop(x{i}, x{j}) AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM scaled",
}


def _power(name: str, matrix: str) -> None:
    """Register ``<name>``: the leading unit eigenvector of a 3 x 3 matrix, by power iteration."""
    row = [f"(m{i}0 * v0 + m{i}1 * v1 + m{i}2 * v2)" for i in range(3)]
    norm = "sqrt(" + " + ".join(f"{r} ** 2" for r in row) + ")"
    CTES[f"{name}_walk"] = f"""
        SELECT 0 AS step, 0.6::DOUBLE AS v0, 0.5::DOUBLE AS v1, 0.4::DOUBLE AS v2
        UNION ALL
        SELECT step + 1, {", ".join(f"{r} / {norm}" for r in row)}
        FROM {name}_walk JOIN {matrix} ON true WHERE step < 300"""
    largest = "greatest(abs(v0), abs(v1), abs(v2))"
    sign = (
        f"CASE WHEN abs(v0) = {largest} THEN sign(v0) WHEN abs(v1) = {largest} THEN sign(v1) ELSE sign(v2) END"
    )
    CTES[name] = f"SELECT {', '.join(f'v{i} * {sign} AS v{i}' for i in range(3))} FROM {name}_walk WHERE step = 300"


_power("axis1", "covariance")
CTES["deflated"] = "SELECT " + ", ".join(
    f"m{i}{j} - size * v{i} * v{j} AS m{i}{j}" for i in range(3) for j in range(3)
) + """ FROM (SELECT *, v0 * (m00 * v0 + m01 * v1 + m02 * v2) + v1 * (m10 * v0 + m11 * v1 + m12 * v2)
                     + v2 * (m20 * v0 + m21 * v1 + m22 * v2) AS size
              FROM covariance JOIN axis1 ON true)"""
_power("axis2", "deflated")


ONE_COUNTRY = f"(SELECT * FROM clean WHERE Country = '{DASHBOARD_COUNTRY}')"
ONE_MONTH = f"(SELECT * FROM clean WHERE year(InvoiceDate) * 100 + month(InvoiceDate) = {DASHBOARD_MONTH})"


def _by_month(rows: str) -> str:
    return f"""
        SELECT year(InvoiceDate) * 100 + month(InvoiceDate) AS month_key,
                   strftime(InvoiceDate, '%b %Y') AS month_year, {KPIS}
        FROM {rows} GROUP BY ALL"""


def _by_country(rows: str) -> str:
    share = f"CAST(sum(TotalPrice) AS DOUBLE) * 100 / CAST((SELECT sum(TotalPrice) FROM {rows}) AS DOUBLE)"
    return f"""
        SELECT Country, CAST(sum(TotalPrice) AS DOUBLE) AS revenue, {even(share, 6)} AS share_pct
        FROM {rows} GROUP BY Country"""


def _top_products(rows: str) -> str:
    return f"""
        SELECT row_number() OVER o AS position, StockCode, CAST(total AS DOUBLE) AS revenue,
                   {even("CAST(total AS DOUBLE) * 100 / everything", 6)} AS share_pct,
                   {even("CAST(sum(total) OVER (o ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100 / everything", 6)}
                   AS running_share_pct
        FROM (SELECT StockCode, sum(TotalPrice) AS total,
                         CAST(sum(sum(TotalPrice)) OVER () AS DOUBLE) AS everything
                  FROM {rows} GROUP BY StockCode)
        WINDOW o AS (ORDER BY total DESC, StockCode) QUALIFY position <= 10"""


def _top_rules(table: str) -> str:
    return f"""
        SELECT segment, row_number() OVER (PARTITION BY segment
                   ORDER BY lift DESC, support DESC, antecedents, consequents) AS position,
               antecedents, consequents, {even("support", 4)} AS support,
               {even("confidence", 4)} AS confidence, {even("lift", 4)} AS lift
        FROM {table} QUALIFY position <= 10"""


def _rules(table: str) -> str:
    measures = (
        "antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage", "conviction"
    )
    bound = """leverage / nullif(greatest(support * (1 - antecedent_support),
               antecedent_support * (consequent_support - support)), 0)"""
    rounded = ", ".join(f"{even(m, 6)} AS {m}" for m in measures)
    return f"SELECT segment, antecedents, consequents, {rounded}, {even(bound, 6)} AS zhang FROM {table}"


def _pivot() -> str:
    cells = []
    for stage in STAGES:
        here, name = f"FILTER (deal_stage = '{stage}')", stage.replace(" ", "_")
        cells.append(f"nullif(count(*) {here}, 0) AS {name}_deals")
        cells.append(f"CAST(sum(CAST(close_value AS DECIMAL(18,4))) {here} AS DOUBLE) AS {name}_value")
    return f"SELECT product, {', '.join(cells)} FROM sales_pipeline GROUP BY product"


def _profile() -> str:
    kinds = {
        "InvoiceNo": "string",
        "StockCode": "string",
        "Description": "string",
        "Quantity": "int",
        "InvoiceDate": "timestamp_ntz",
        "UnitPrice": "decimal(18,4)",
        "CustomerID": "string",
        "Country": "string",
    }
    first = (
        "(SELECT * FROM transactions ORDER BY InvoiceDate, InvoiceNo, StockCode, Quantity, UnitPrice LIMIT 1)"
    )
    rows = []
    for name, kind in kinds.items():
        value = f"CAST({name} AS VARCHAR)"
        if name == "InvoiceDate":
            value = "strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S')"
        rows.append(
            f"SELECT '{name}' AS Attribute, '{kind}' AS DataType, {value} AS ExampleValue, "
            f"'{TRANSACTION_DESCRIPTIONS[name]}' AS Description FROM {first}"
        )
    return " UNION ALL ".join(rows)


def _correlation() -> str:
    cells = []
    for x in RFM:
        for y in RFM:
            value = "1.0::DOUBLE" if x == y else f"corr({x}::DOUBLE, {y}::DOUBLE)"
            cells.append(
                f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, {even(f'any_value({value})' if x == y else value, 2)} AS r FROM base"
            )
    return " UNION ALL ".join(cells)


def _missing_rows(condition: str) -> str:
    return f"SELECT {TX} FROM transactions WHERE {condition}"


def _scaled(columns: Sequence[str]) -> str:
    raw = [(f"{n}_scaled", f"{n}::DOUBLE") for n in RFM]
    logs = [(f"{n}_log_scaled", f"ln(1 + {n}::DOUBLE)") for n in columns]
    cells = ", ".join(
        f"{even(f'({e} - avg({e}) OVER ()) / stddev_pop({e}) OVER ()', 6)} AS {n}" for n, e in raw + logs
    )
    return f"SELECT CustomerID, {cells} FROM feat"


def statements() -> dict[str, str]:
    """Final SELECT per query, before its common table expressions are added."""
    counted = ", ".join(f"count(*) FILTER ({n} IS NULL) AS {n}" for n in TRANSACTION_DESCRIPTIONS)
    box = "quantile_cont(Monetary, [0.25, 0.5, 0.75])"
    fence = "q3 + 1.5::DOUBLE * (q3 - q1)"
    quartiles = "(SELECT quantile_cont(Monetary, 0.25) AS q1, quantile_cont(Monetary, 0.75) AS q3 FROM base)"
    feature_text = "Recency, Frequency, ProductDiversity, AvgDaysBetweenTransactions"
    sets_text = "array_to_string(items, ', ')"
    return {
        "load_transactions": f"SELECT {TX} FROM transactions",
        "load_workbooks": f"SELECT {TX} FROM transactions",
        "sink_csv": _summary("seg3", "segment", RFM),
        "sink_partitioned": "SELECT * FROM seg3",
        "dataset_profile": _profile(),
        "rows_with_missing": _missing_rows(
            " OR ".join(f"{n} IS NULL" for n in TRANSACTION_DESCRIPTIONS)
        ),
        "rows_missing_customer": _missing_rows("CustomerID IS NULL"),
        "missing_counts": f"""
            SELECT "Column", MissingCount FROM
            (UNPIVOT (SELECT {counted} FROM transactions) ON COLUMNS(*) INTO NAME "Column" VALUE MissingCount)""",
        "rfm_stats": _statistics("base", RFM),
        "extended_stats": _statistics("feat", EXTENDED),
        "iqr_fence": f"""
            SELECT {even("q1", 4)} AS q1, {even("q3", 4)} AS q3, {even("q3 - q1", 4)} AS iqr,
                   {even(fence, 4)} AS upper_fence FROM {quartiles}""",
        "rfm_without_outliers": f"SELECT base.* FROM base JOIN {quartiles} ON Monetary <= {fence}",
        "rfm_correlation": _correlation(),
        "feature_histograms": " UNION ALL ".join(_histogram(n, b) for n, b in HISTOGRAM_BINS.items()),
        "monetary_box_stats": f"""
            SELECT 'Monetary' AS feature, {even("any_value(q[1])", 4)} AS q25,
                   {even("any_value(q[2])", 4)} AS median, {even("any_value(q[3])", 4)} AS q75,
                   min(Monetary) FILTER (Monetary BETWEEN lo AND hi) AS whisker_low,
                   max(Monetary) FILTER (Monetary BETWEEN lo AND hi) AS whisker_high,
                   count(*) FILTER (Monetary < lo) AS fliers_low,
                   count(*) FILTER (Monetary > hi) AS fliers_high
            FROM (SELECT Monetary, q, q[1] - 1.5::DOUBLE * (q[3] - q[1]) AS lo,
                         q[3] + 1.5::DOUBLE * (q[3] - q[1]) AS hi
                  FROM base JOIN (SELECT {box} AS q FROM base) ON true)""",
        "clean_transactions": f"SELECT {TX}, CAST(TotalPrice AS DOUBLE) AS TotalPrice FROM clean",
        "rfm": "SELECT * FROM base",
        "avg_purchase_value": "SELECT CustomerID, AvgPurchaseValue FROM feat",
        "product_diversity": "SELECT * FROM diversity",
        "invoice_gaps": f"""
            SELECT CustomerID, InvoiceNo, {STAMP},
                   CAST(DaysBetweenTransactions AS DOUBLE) AS DaysBetweenTransactions FROM gap""",
        "avg_days_between": "SELECT * FROM gap_mean",
        "customer_features": "SELECT * FROM feat",
        "customers_capped": (
            f"SELECT * FROM feat WHERE Frequency <= {FREQUENCY_LIMIT} AND Monetary <= {MONETARY_LIMIT}"
        ),
        "rfm_log": "SELECT *, "
        + ", ".join(f"{even(f'ln(1 + {n}::DOUBLE)', 6)} AS {n}_log" for n in RFM)
        + " FROM base",
        "scaled_features": _scaled(EXTENDED),
        "total_revenue_won": (
            f"SELECT {_won('close_value')} AS total_revenue FROM sales_pipeline WHERE deal_stage = 'Won'"
        ),
        "total_opportunities": "SELECT count(*) AS total_opportunities FROM sales_pipeline",
        "win_rate": f"""
            SELECT {up("100.0::DOUBLE * sum(CASE WHEN deal_stage = 'Won' THEN 1 ELSE 0 END) / count(*)", 2)}
                   AS win_rate FROM sales_pipeline""",
        "closed_win_rate": f"""
            SELECT {up("100.0::DOUBLE * sum(CASE WHEN deal_stage = 'Won' THEN 1 ELSE 0 END) / sum(CASE WHEN deal_stage IN ('Won', 'Lost') THEN 1 ELSE 0 END)", 2)}
                   AS closed_win_rate FROM sales_pipeline""",
        "stage_counts": (
            "SELECT deal_stage, count(*) AS opportunities FROM sales_pipeline GROUP BY deal_stage"
        ),
        "avg_won_deal": f"""
            SELECT {up("CAST(sum(CAST(close_value AS DECIMAL(18,4))) AS DOUBLE) / count(close_value)", 2)}
                   AS avg_won_deal FROM sales_pipeline WHERE deal_stage = 'Won'""",
        "active_pipeline": """
            SELECT count(*) FILTER (coalesce(deal_stage, '') NOT IN ('Won', 'Lost')) AS active_opportunities
            FROM sales_pipeline""",
        "revenue_by_sector": f"""
            SELECT a.sector, {_won("sp.close_value")} AS revenue
            FROM sales_pipeline sp JOIN accounts a ON sp.account = a.account
            WHERE sp.deal_stage = 'Won' GROUP BY a.sector ORDER BY revenue DESC""",
        "revenue_by_product": f"""
            SELECT product, {_won("close_value")} AS revenue FROM sales_pipeline
            WHERE deal_stage = 'Won' GROUP BY product""",
        "revenue_by_manager": f"""
            SELECT manager, {_won("close_value")} AS revenue
            FROM sales_pipeline JOIN sales_teams USING (sales_agent)
            WHERE deal_stage = 'Won' GROUP BY manager""",
        "opportunity_explorer": """
            SELECT p.*, manager FROM sales_pipeline p JOIN sales_teams USING (sales_agent)
            WHERE manager IN ('Manager#1', 'Manager#2') AND product IN ('1-URGENT', '2-HIGH')
              AND deal_stage IN ('Won', 'Active A')""",
        "pipeline_pivot": _pivot(),
        "retail_kpis": f"SELECT {KPIS} FROM clean",
        "retail_kpis_filtered": f"""
            SELECT {KPIS}, '{DASHBOARD_COUNTRY}' AS page FROM clean WHERE Country = '{DASHBOARD_COUNTRY}'
            UNION ALL
            SELECT {KPIS}, '{DASHBOARD_MONTH}' AS page FROM clean
            WHERE year(InvoiceDate) * 100 + month(InvoiceDate) = {DASHBOARD_MONTH}""",
        "revenue_by_month": _by_month("clean"),
        "revenue_by_month_in_country": _by_month(ONE_COUNTRY),
        "revenue_by_country": _by_country("clean"),
        "revenue_by_country_in_month": _by_country(ONE_MONTH),
        "product_concentration": f"""
            SELECT StockCode, CAST(total AS DOUBLE) AS revenue, rank() OVER (ORDER BY total DESC) AS rank,
                   {even("CAST(sum(total) OVER (ORDER BY total DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) * 100 / CAST(sum(total) OVER () AS DOUBLE)", 6)}
                   AS running_share_pct
            FROM (SELECT StockCode, sum(TotalPrice) AS total FROM clean GROUP BY StockCode)""",
        "top_products": _top_products("clean"),
        "top_products_in_country": _top_products(ONE_COUNTRY),
        "top_products_in_month": _top_products(ONE_MONTH),
        "attrition_overall": f"""
            SELECT employees, departures, attrition_pct
            FROM ({_attrition("0", "0")})""",
        "attrition_by_dimension": " UNION ALL ".join(
            _attrition(f"'{n}'", f"CAST({n} AS VARCHAR)") for n in ("department", "overtime", "job_role")
        ),
        "attrition_by_tenure": f"""
            SELECT value AS tenure_band, employees, departures, attrition_pct FROM (
            {_attrition("0", "CASE WHEN years_at_company <= 5 THEN 'first 5 years' ELSE 'after 5 years' END")})""",
        "daily_sales": f"SELECT series, {DATE}, Sales FROM day",
        "rolling_sales": f"""
            SELECT series, {DATE}, Sales,
                   CASE WHEN count(*) OVER w = 7
                        THEN CAST(sum(CAST(Sales AS DECIMAL(18,4))) OVER w AS DOUBLE) / 7 END AS RollingMean
            FROM day WINDOW w AS (ORDER BY Date ROWS 6 PRECEDING)""",
        "monthly_sales": """
            SELECT 'all' AS series, strftime(last_day(m), '%Y-%m-%d') AS MonthEnd,
                   coalesce(CAST(sum(TotalPrice) AS DOUBLE), 0.0) AS Sales
            FROM (SELECT unnest(generate_series(date_trunc('month', min(InvoiceDate)),
                         date_trunc('month', max(InvoiceDate)) - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m
                  FROM clean)
            LEFT JOIN clean ON date_trunc('month', InvoiceDate) = m GROUP BY m""",
        "daily_sales_filled": f"SELECT series, {DATE}, Sales FROM country_filled",
        "holdout_split": f"""
            SELECT series, {DATE}, Sales, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part
            FROM all_parts""",
        "backtest_window": f"""
            SELECT series, {DATE}, Sales, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part
            FROM window_parts""",
        "forecast_design_sums": f"""
            SELECT series, count(d4) AS rows, {DESIGN_SUMS} FROM design GROUP BY series""",
        "forecast_series": f"""
            SELECT series, {DATE}, ActualSales, PredictedSales
            FROM ({_compare("country_parts", "arima_country_path")})""",
        "forecast_metrics": _forecast_metrics(_compare("country_parts", "naive"), "Last value"),
        "forecast_metrics_arima": _forecast_metrics(
            _compare("all_parts", "arima_all_path"), "ARIMA(4,1,1)"
        ),
        "backtest_comparison": f"""
            SELECT series, {DATE}, ActualSales, PredictedSales
            FROM ({_compare("window_parts", "arima_window_path")})""",
        "backtest_metrics": f"""
            SELECT *, '{BACKTEST_START} to {BACKTEST_END}' AS ValidationPeriod
            FROM ({_forecast_metrics(_compare("window_parts", "arima_window_path"), "ARIMA(4,1,1)")})""",
        "train_test_split": "SELECT CustomerID, is_test FROM digests",
        "spend_regression": f"""
            SELECT unnest(['Intercept', 'Recency', 'Frequency']) AS term,
                   unnest([{even("my", 4)}, {even("(n * s1y - s12 * s2y) / (n * n - s12 * s12)", 4)},
                           {even("(n * s2y - s12 * s1y) / (n * n - s12 * s12)", 4)}]) AS coefficient
            FROM ols_sums""",
        "actual_vs_predicted": f"""
            SELECT CustomerID, {even("actual", 2)} AS ActualMonetary, {even("predicted", 2)} AS PredictedMonetary
            FROM ols2_fit WHERE NOT fit""",
        "regression_metrics": _fit_metrics("Linear Regression", "Recency, Frequency", "ols2_fit"),
        "spend_regression_capped": f"""
            SELECT *, {FREQUENCY_LIMIT}::BIGINT AS FrequencyLimit, {MONETARY_LIMIT}::DOUBLE AS MonetaryLimit
            FROM ({_fit_metrics("Filtered Linear Regression", "Recency, Frequency", "olsc_fit")})""",
        "regression_comparison": _fit_metrics("Baseline Regression", "Recency, Frequency", "ols2_fit")
        + " UNION ALL "
        + _fit_metrics("Extended Feature Regression", feature_text, "ols4_fit"),
        "cluster_summary": _summary("seg3", "segment", RFM),
        "cluster_summary_extended": _summary("feat4", "segment", EXTENDED),
        "silhouette": f"""
            SELECT 'segment' AS label_column, {even("s", 4)} AS silhouette FROM ({_silhouette("space3")})""",
        "silhouette_euclidean": _euclidean("space3", "segment"),
        "kmeans_silhouette_euclidean": " UNION ALL ".join(_euclidean(f"km{k}", f"cluster_{k}") for k in SWEPT),
        "davies_bouldin": f"SELECT {even('db', 4)} AS davies_bouldin FROM ({_davies_bouldin('space3')})",
        "best_k": "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT 'Quantiles' AS Method, {k}::BIGINT AS Clusters, {even('s', 4)} AS SilhouetteScore, "
            f"{even('db', 4)} AS DaviesBouldinIndex "
            f"FROM ({_silhouette(f'space{k}')}) JOIN ({_davies_bouldin(f'space{k}')}) ON true"
            for k in (2, 3, 4)
        )
        + ") ORDER BY SilhouetteScore DESC, Clusters LIMIT 1",
        "kmeans_sweep": "SELECT * FROM km_scores",
        "kmeans_sweep_extended": _sweep("kmx", "KMeans_ExtendedFeatures", len(EXTENDED), SWEPT, "distances6"),
        "best_k_kmeans": "SELECT * FROM km_scores ORDER BY SilhouetteScore DESC, Clusters LIMIT 1",
        "segment_customers": f"""
            SELECT a.CustomerID, {", ".join(f"a.{n}" for n in RFM)}, a.cluster AS cluster_3, b.cluster AS cluster_4
            FROM {_ordered("kmp", 3, "base")} a JOIN {_ordered("kmp", 4, "base")} b USING (CustomerID)""",
        "segment_customers_extended": f"""
            SELECT a.CustomerID, a.cluster AS cluster_3, b.cluster AS cluster_4
            FROM {_ordered("kmpx", 3, "feat")} a JOIN {_ordered("kmpx", 4, "feat")} b USING (CustomerID)""",
        "segment_summary": " UNION ALL ".join(
            f"SELECT *, {k}::BIGINT AS Clusters FROM ({_summary(_ordered('kmp', k, 'base'), 'cluster', RFM)})"
            for k in (3, 4)
        ),
        "segment_summary_extended": " UNION ALL ".join(
            f"SELECT *, {k}::BIGINT AS Clusters FROM ({_summary(_ordered('kmpx', k, 'feat'), 'cluster', EXTENDED)})"
            for k in (3, 4)
        ),
        "winning_summary": " UNION ALL ".join(
            f"SELECT *, {k}::BIGINT AS Clusters FROM ({_summary(f'km{k}_ordered', 'cluster', RFM)})" for k in SWEPT
        ),
        "segment_without_outliers": _sweep("kmf", "KMeans_Filtered", 3, (2,), "distances_kept"),
        "density_cells": """
            SELECT core, count(*) AS cells, CAST(sum(points) AS BIGINT) AS points,
                   CAST(max(block_points) AS BIGINT) AS largest_block FROM blocks GROUP BY core""",
        "density_clusters": "SELECT CustomerID, cluster FROM dense",
        "density_summary": _summary("dense_features", "cluster", RFM),
        "density_silhouette": "SELECT "
        + even("s", 3)
        + " AS silhouette FROM ("
        + _silhouette("dense_kept")
        + ")",
        "pca_projection": f"""
            SELECT CustomerID, Monetary,
                   {even("x0 * a.v0 + x1 * a.v1 + x2 * a.v2", 4)} AS PC1,
                   {even("x0 * b.v0 + x1 * b.v1 + x2 * b.v2", 4)} AS PC2
            FROM scaled JOIN base USING (CustomerID) JOIN axis1 a ON true JOIN axis2 b ON true""",
        "basket_items": "SELECT * FROM items",
        "frequent_itemsets": f"SELECT segment, {sets_text} AS items, freq, n AS baskets FROM sets",
        "frequent_itemsets_deep": f"SELECT segment, {sets_text} AS items, freq, n AS baskets FROM sets_deep",
        "frequent_pairs": """
            SELECT segment, items[1] AS item_a, items[2] AS item_b, freq, freq::DOUBLE / n AS support
            FROM sets WHERE len(items) = 2""",
        "association_rules": _rules("rule"),
        "association_rules_deep": _rules("rule_deep"),
        "rules_dedup": f"SELECT segment, antecedents, consequents, {even('lift', 6)} AS lift FROM unmirrored",
        "rules_dedup_deep": (
            f"SELECT segment, antecedents, consequents, {even('lift', 6)} AS lift FROM unmirrored_deep"
        ),
        "top_rules": _top_rules("unmirrored"),
        "best_rules": _top_rules("unmirrored"),
        "best_rules_deep": _top_rules("unmirrored_deep"),
    }


def oracle_sql() -> dict[str, str]:
    return {name: chain(text) for name, text in statements().items()}
