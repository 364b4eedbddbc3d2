"""Explicit schemas: nothing in this library infers types from data."""

TRANSACTIONS = (
    "InvoiceNo string, StockCode string, Description string, Quantity int, "
    "InvoiceDate timestamp_ntz, UnitPrice decimal(18,4), CustomerID string, Country string"
)

# The meaning of each transaction attribute, in schema order (fixed values).
TRANSACTION_DESCRIPTIONS = {
    "InvoiceNo": "Unique transaction ID",
    "StockCode": "Product code",
    "Description": "Product description",
    "Quantity": "Quantity of product purchased",
    "InvoiceDate": "Date and time of transaction",
    "UnitPrice": "Price per unit",
    "CustomerID": "Unique customer identifier",
    "Country": "Country of customer",
}

# Columns of the star-schema tables that the adapter views read.
STAR_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, "
        "p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
}
