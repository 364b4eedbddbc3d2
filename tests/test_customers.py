"""Cleaning and customer features against a pandas calculation."""

import numpy as np
import pandas as pd
import pytest

from ledgerloom.operators import customers
from ledgerloom.operators.cleaning import clean_transactions
from ledgerloom.sources import schemas


def sales(rows=2000, customers_count=40, hot_share=0.0, seed=0):
    """Transactions with every defect; one customer may hold a share of all rows."""
    rng = np.random.default_rng(seed)
    customer = rng.integers(1, customers_count, rows)
    customer[rng.random(rows) < hot_share] = 1
    invoice = customer * 100 + rng.integers(0, 30, rows)
    start = pd.Timestamp("2011-01-01")
    minutes = (invoice * 7919) % 500_000 + rng.integers(0, 5, rows)
    frame = pd.DataFrame(
        {
            "InvoiceNo": np.where(invoice % 17 == 0, "C", "") + pd.Series(invoice).astype(str),
            "StockCode": pd.Series(rng.integers(0, 60, rows)).astype(str),
            "Description": "thing",
            "Quantity": rng.integers(-1, 9, rows).astype("int32"),
            "InvoiceDate": start + pd.to_timedelta(minutes, unit="min"),
            "UnitPrice": rng.integers(0, 900, rows) / 100,
            "CustomerID": [None if i % 29 == 0 else str(c) for i, c in enumerate(customer)],
            "Country": "X",
        }
    )
    return frame


def to_spark(spark, frame):
    from decimal import Decimal

    typed = frame.assign(UnitPrice=[Decimal(f"{p:.4f}") for p in frame["UnitPrice"]])
    rows = [tuple(r) for r in typed.astype(object).itertuples(index=False)]
    rows = [(*r[:4], r[4].to_pydatetime(), *r[5:]) for r in rows]
    return spark.createDataFrame(rows, schemas.TRANSACTIONS)


def expected_features(frame):
    kept = frame.dropna(subset=["CustomerID"])
    kept = kept[~kept.InvoiceNo.str.startswith("C") & (kept.Quantity > 0) & (kept.UnitPrice > 0)]
    kept = kept.assign(Total=kept.Quantity * kept.UnitPrice)
    snapshot = kept.InvoiceDate.max() + pd.Timedelta(days=1)
    grouped = kept.groupby("CustomerID")
    first = kept.groupby(["CustomerID", "InvoiceNo"]).InvoiceDate.min().reset_index()
    first = first.sort_values(["CustomerID", "InvoiceDate"])
    first["gap"] = first.groupby("CustomerID").InvoiceDate.diff().dt.days
    result = pd.DataFrame(
        {
            "Recency": (snapshot - grouped.InvoiceDate.max()).dt.days,
            "Frequency": grouped.InvoiceNo.nunique(),
            "Monetary": grouped.Total.sum(),
            "ProductDiversity": grouped.StockCode.nunique(),
            "AvgDaysBetweenTransactions": first.groupby("CustomerID").gap.mean().fillna(0),
        }
    )
    result["AvgPurchaseValue"] = result.Monetary / result.Frequency
    return result


@pytest.mark.parametrize("hot_share", [0.0, 0.4])
def test_features_match_pandas(spark, hot_share):
    frame = sales(hot_share=hot_share)
    got = customers.customer_features(clean_transactions(to_spark(spark, frame))).toPandas()
    got = got.set_index("CustomerID").sort_index()
    expected = expected_features(frame).sort_index()
    assert list(got.index) == list(expected.index)
    for name in customers.EXTENDED:
        np.testing.assert_allclose(got[name], expected[name], rtol=1e-9, err_msg=name)


def test_fused_features_equal_the_separate_ones(spark):
    clean = clean_transactions(to_spark(spark, sales(seed=3)))
    fused = customers.customer_features(clean)
    joined = (
        customers.rfm(clean)
        .join(customers.average_purchase_value(clean), "CustomerID", "left")
        .join(customers.product_diversity(clean), "CustomerID", "left")
        .join(customers.average_days_between(clean), "CustomerID", "left")
    )
    assert fused.select(joined.columns).exceptAll(joined).isEmpty()
    assert joined.exceptAll(fused.select(joined.columns)).isEmpty()


def test_gaps_follow_the_previous_invoice(spark):
    frame = sales(seed=4)
    clean = clean_transactions(to_spark(spark, frame))
    got = customers.invoice_gaps(clean).toPandas().sort_values(["CustomerID", "InvoiceDate", "InvoiceNo"])
    expected = got.groupby("CustomerID").InvoiceDate.diff().dt.days
    pd.testing.assert_series_equal(
        got.DaysBetweenTransactions.astype(float), expected, check_names=False, check_dtype=False
    )


def test_one_invoice_gives_a_gap_of_zero(spark):
    frame = sales(rows=1, seed=1).assign(CustomerID="7", Quantity=1, UnitPrice=1.0, InvoiceNo="5")
    row = customers.customer_features(clean_transactions(to_spark(spark, frame))).first()
    assert (row.Recency, row.Frequency, row.AvgDaysBetweenTransactions) == (1, 1, 0.0)


def test_cancelled_prefix_is_case_sensitive(spark):
    frame = sales(rows=2, seed=1).assign(
        CustomerID="7", Quantity=1, UnitPrice=1.0, InvoiceNo=["C1", "c1"]
    )
    kept = clean_transactions(to_spark(spark, frame)).collect()
    assert [r.InvoiceNo for r in kept] == ["c1"]


def test_partition_count_does_not_change_results(spark):
    clean = clean_transactions(to_spark(spark, sales(seed=5)))
    results = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(map(tuple, customers.customer_features(clean).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_filters_reach_the_scan(spark, tmp_path):
    to_spark(spark, sales(seed=6)).write.parquet(str(tmp_path / "tx"))
    from ledgerloom.sources.tables import load_transactions

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    clean = clean_transactions(load_transactions(spark, str(tmp_path / "tx")))
    plan = clean.select("CustomerID")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in (
        "Not(StringStartsWith(InvoiceNo,C))",
        "GreaterThan(Quantity,0)",
        "GreaterThan(UnitPrice,0.0000)",
        "IsNotNull(CustomerID)",
    ):
        assert pushed in plan.split("PushedFilters")[1]
    assert "Description" not in plan.split("ReadSchema")[1]


def test_ids_read_as_decimals_and_csv_input(spark, tmp_path):
    from ledgerloom.sources.tables import load_transactions

    frame = sales(rows=30, seed=8).assign(CustomerID="17850.0", Quantity=2, UnitPrice=1.5)
    frame.to_csv(tmp_path / "tx.csv", index=False)
    clean = clean_transactions(load_transactions(spark, str(tmp_path / "tx.csv"), "csv"))
    row = clean.select("CustomerID", "TotalPrice").distinct().collect()
    assert [(r.CustomerID, float(r.TotalPrice)) for r in row] == [("17850", 3.0)]


def test_ids_read_as_numbers_of_any_size(spark):
    base = sales(rows=8, seed=9).assign(Quantity=2, UnitPrice=1.5, InvoiceNo="1")
    ids = [12345678.0, 12999999.0, 17850.0, float("nan"), 1e15, 5.0, 6.0, 7.0]
    doubles = spark.createDataFrame(base.assign(CustomerID=ids))
    got = {row.CustomerID for row in clean_transactions(doubles).collect()}
    assert got == {"12345678", "12999999", "17850", "1000000000000000", "5", "6", "7"}
    texts = ["1.2345678E7", "17850.0", "17850", "abc", "12", "13", "14", "15"]
    found = {row.CustomerID for row in clean_transactions(spark.createDataFrame(base.assign(CustomerID=texts))).collect()}
    assert found == {"12345678", "17850", "12", "13", "14", "15"}
