"""Pipeline, retail, attrition and time series."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attrition, forecast, retail, revenue, timeseries
from ledgerloom.sources import tables

PIPELINE = (
    "opportunity_id bigint, sales_agent string, product string, account string, "
    "deal_stage string, close_value double"
)


@pytest.fixture(scope="module")
def pipeline(spark):
    rows = [
        (1, "a", "P", "x", "Won", 100.5),
        (2, "a", "P", None, "Won", 50.0),
        (3, "b", "Q", "y", "Lost", 0.0),
        (4, "b", "Q", "y", "Engaging", None),
        (5, "c", "Q", "x", "won", None),
    ]
    return spark.createDataFrame(rows, PIPELINE)


def test_pipeline_kpis(spark, pipeline):
    assert revenue.total_revenue_won(pipeline).first()[0] == 151.0
    assert revenue.total_opportunities(pipeline).first()[0] == 5
    assert revenue.win_rate(pipeline).first()[0] == 40.0
    assert revenue.closed_win_rate(pipeline).first()[0] == 66.67
    assert revenue.average_won_deal(pipeline).first()[0] == 75.25
    assert revenue.active_pipeline(pipeline).first()[0] == 2
    stages = {r.deal_stage: r.opportunities for r in revenue.stage_counts(pipeline).collect()}
    assert stages == {"Won": 2, "Lost": 1, "Engaging": 1, "won": 1}


def test_no_closed_deals_give_null_not_an_error(pipeline):
    active = pipeline.filter("deal_stage = 'Engaging'")
    assert revenue.closed_win_rate(active).first()[0] is None
    assert revenue.win_rate(active.limit(0)).first()[0] is None


def test_unknown_accounts_drop_out_of_sectors(spark, pipeline):
    accounts = spark.createDataFrame([("x", "retail"), ("y", "medical")], "account string, sector string")
    rows = [tuple(r) for r in revenue.revenue_by_sector(pipeline, accounts).collect()]
    # 100.5 rounds away from zero.
    assert rows == [("retail", 101.0)]


def test_explorer_filters_combine(spark, pipeline):
    teams = spark.createDataFrame([("a", "M"), ("b", "N")], "sales_agent string, manager string")
    assert revenue.explore(pipeline, teams).count() == 5
    assert revenue.explore(pipeline, teams, managers=["M"]).count() == 2
    assert revenue.explore(pipeline, teams, managers=["N"], stages=["Lost"]).count() == 1
    assert revenue.explore(pipeline, teams, products=["P"], agents=["b"]).count() == 0


def test_attrition_dimensions(spark):
    rows = [(1, True, "A", True, 3, "J"), (2, False, "A", False, 7, "K"), (3, True, "B", True, 5, "J")]
    staff = spark.createDataFrame(
        rows,
        "employee_id bigint, attrition boolean, department string, overtime boolean, "
        "years_at_company int, job_role string",
    )
    got = {
        (r.dimension, r.value): (r.employees, r.departures, r.attrition_pct)
        for r in attrition.attrition_by_dimension(staff).collect()
    }
    assert got[("department", "A")] == (2, 1, 50.0)
    assert got[("overtime", "true")] == (2, 2, 100.0)
    assert len(got) == 6
    bands = {r.tenure_band: r.departures for r in attrition.attrition_by_tenure(staff).collect()}
    assert bands == {"first 5 years": 2, "after 5 years": 0}


def _clean(spark, rows):
    return spark.createDataFrame(
        [
            (inv, code, cust, datetime.combine(day, datetime.min.time()), 1, Decimal(total), "X")
            for inv, code, cust, day, total in rows
        ],
        "InvoiceNo string, StockCode string, CustomerID string, InvoiceDate timestamp_ntz, "
        "Quantity int, TotalPrice decimal(18,4), Country string",
    )


def test_concentration_shares_ranks_between_equal_products(spark):
    day = date(2011, 1, 1)
    clean = _clean(spark, [("1", c, "1", day, t) for c, t in zip("abcd", ("5", "3", "3", "1"))])
    got = {r.StockCode: (r["rank"], r.running_share_pct) for r in retail.product_concentration(clean).collect()}
    assert got["a"][0] == 1 and got["b"] == got["c"] and got["b"][0] == 2 and got["d"][0] == 4
    assert got["b"][1] == pytest.approx(1100 / 12)
    assert got["d"][1] == pytest.approx(100)
    top = retail.top_products(clean, 2).collect()
    assert [r.StockCode for r in top] == ["a", "b"]
    assert top[1].running_share_pct == pytest.approx(800 / 12)


def test_month_filter_matches_month_key(spark):
    days = [date(2011, 10, 31), date(2011, 11, 1), date(2011, 11, 30), date(2011, 12, 1)]
    clean = _clean(spark, [(str(i), "a", "1", d, "1") for i, d in enumerate(days)])
    assert retail.dashboard_filter(clean, months=[201111]).count() == 2
    assert retail.dashboard_filter(clean, countries=["Y"]).count() == 0


def _daily(spark, values, start=date(2011, 1, 1), step=1):
    rows = [("all", start + timedelta(days=i * step), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, Date date, Sales double")


def test_rolling_mean_needs_seven_rows(spark):
    rows = timeseries.rolling_sales(_daily(spark, range(9), step=3)).orderBy("Date").collect()
    assert [r.RollingMean for r in rows] == [None] * 6 + [3.0, 4.0, 5.0]


def test_months_are_dense_and_the_last_is_dropped(spark):
    days = [date(2011, 1, 5), date(2011, 3, 9), date(2011, 4, 1)]
    clean = _clean(spark, [("1", "a", "1", d, "2") for d in days])
    rows = timeseries.monthly_sales(clean).orderBy("MonthEnd").collect()
    assert [(r.MonthEnd, r.Sales) for r in rows] == [
        (date(2011, 1, 31), 2.0),
        (date(2011, 2, 28), 0.0),
        (date(2011, 3, 31), 2.0),
    ]


def test_spine_covers_every_day(spark):
    rows = timeseries.fill_days(_daily(spark, [1, 2, 3], step=4)).collect()
    assert len(rows) == 9 and sum(r.Sales for r in rows) == 6.0


def test_backtest_bounds_are_inclusive(spark):
    split = timeseries.window_split(_daily(spark, range(20)), date(2011, 1, 10), date(2011, 1, 16))
    counts = {r.part: r["count"] for r in split.groupBy("part").count().collect()}
    assert counts == {"train": 9, "test": 7}


def test_arima_matches_a_direct_fit(spark):
    rng = np.random.default_rng(2)
    sales = np.cumsum(rng.normal(0, 5, 120)) + 100
    got = forecast.arima_forecast(_daily(spark, sales), steps=7).orderBy("Date").collect()
    diff = np.diff(sales)
    long = np.array([diff[t - 8 : t][::-1] for t in range(8, len(diff))])
    beta = np.linalg.lstsq(long, diff[8:], rcond=None)[0]
    shock = diff[8:] - long @ beta
    design = np.array(
        [[*diff[t - 4 : t][::-1], shock[t - 9]] for t in range(9, len(diff))]
    )
    phi = np.linalg.lstsq(design, diff[9:], rcond=None)[0]
    recent, last, level, path = list(diff[::-1][:4]), shock[-1], sales[-1], []
    for _ in range(7):
        step = float(phi[:4] @ recent[:4] + phi[4] * last)
        recent, last, level = [step, *recent], 0.0, level + step
        path.append(level)
    np.testing.assert_allclose([r.PredictedSales for r in got], path, rtol=1e-6)
    assert got[0].Date == date(2011, 1, 1) + timedelta(days=120)


def test_short_series_falls_back_to_the_last_level(spark):
    got = forecast.arima_forecast(_daily(spark, [5, 6, 7]), steps=2).collect()
    assert [r.PredictedSales for r in got] == [7.0, 7.0]


def test_forecast_errors_skip_zero_actuals_only_in_mape(spark):
    rows = [("all", date(2011, 1, 1), 0.0, 2.0), ("all", date(2011, 1, 2), 10.0, 5.0)]
    compared = spark.createDataFrame(
        rows, "series string, Date date, ActualSales double, PredictedSales double"
    )
    row = forecast.forecast_metrics(compared, "m", "7 Days").first()
    assert (row.MAE, row.RMSE, row.MAPE) == (3.5, 3.81, 50.0)


def test_csv_sink_flattens_arrays(spark, tmp_path):
    frame = spark.createDataFrame([(1, ["b", "a"])], "k int, items array<string>")
    tables.write_csv(frame, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), "k int, items string").first()
    assert tuple(back) == (1, "a, b")


def test_partitioned_sink_keeps_one_folder_per_key(spark, tmp_path):
    frame = spark.range(6).withColumn("cluster", (F.col("id") % 2).cast("int"))
    tables.write_partitioned(frame, str(tmp_path / "out"), ["cluster"])
    folders = {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert folders == {"cluster=0", "cluster=1"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_products_are_dealt_out_before_their_lines_are_summed(spark):
    """No task that reads lines holds sums for the whole catalogue; a dominant product is summed in parts."""
    lines = [("best" if i % 3 else f"p{i}", str(i), Decimal(i)) for i in range(900)]
    clean = spark.createDataFrame(lines, "StockCode string, InvoiceNo string, TotalPrice decimal(18,4)")
    best = retail.top_products(clean, 1)
    total = sum(i for i in range(900) if i % 3)
    assert (best.first().StockCode, best.first().revenue) == ("best", float(total))
    plan = retail.product_concentration(clean)._jdf.queryExecution().sparkPlan().toString()
    first_sum = plan.rindex("partial_sum(TotalPrice")
    assert "RepartitionByExpression" in plan[first_sum:] or "REPARTITION_BY_COL" in plan[first_sum:]
