"""Views that present the star-schema tables as retail, CRM and HR inputs.

One SQL text per view serves Spark here and the checking engine in
``plans.oracle``; only the expression that adds minutes to a date differs.
Braces name the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.tables import star_table

TRANSACTIONS = """
SELECT CASE WHEN o.o_orderkey % 20 = 0 THEN 'C' || CAST(o.o_orderkey AS STRING)
            ELSE CAST(o.o_orderkey AS STRING) END AS InvoiceNo,
       CAST(l.l_partkey AS STRING) AS StockCode,
       CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE p.p_brand END AS Description,
       CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1
                 THEN -l.l_quantity ELSE l.l_quantity END AS INT) AS Quantity,
       o.o_orderdate + {MINUTES} AS InvoiceDate,
       CAST(CASE WHEN l.l_linenumber = 2 AND l.l_orderkey % 31 = 0
                 THEN 0 ELSE p.p_retailprice END AS DECIMAL(18,4)) AS UnitPrice,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL
            ELSE CAST(o.o_custkey AS STRING) END AS CustomerID,
       n.n_name AS Country
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {part} p ON l.l_partkey = p.p_partkey
"""

SALES_PIPELINE = """
SELECT o.o_orderkey AS opportunity_id,
       'Agent#' || CAST(o.o_orderkey % 30 AS STRING) AS sales_agent,
       o.o_orderpriority AS product,
       CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE c.c_name END AS account,
       CASE WHEN o.o_orderstatus = 'F' THEN 'Won'
            WHEN o.o_orderstatus = 'P' THEN 'Lost'
            WHEN o.o_orderkey % 2 = 0 THEN 'Active A' ELSE 'Active B' END AS deal_stage,
       CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice
            WHEN o.o_orderstatus = 'P' THEN CAST(0 AS DOUBLE) END AS close_value
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

ACCOUNTS = "SELECT c_name AS account, c_mktsegment AS sector FROM {customer}"

SALES_TEAMS = """
SELECT DISTINCT 'Agent#' || CAST(o_orderkey % 30 AS STRING) AS sales_agent,
       'Manager#' || CAST((o_orderkey % 30) % 6 AS STRING) AS manager
FROM {orders}
"""

EMPLOYEES = """
SELECT c.c_custkey AS employee_id, c.c_acctbal < 0 AS attrition, c.c_mktsegment AS department,
       c.c_custkey % 3 = 0 AS overtime, CAST(c.c_custkey % 20 AS INT) AS years_at_company,
       n.n_name AS job_role
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

VIEWS = {
    "transactions": (TRANSACTIONS, ("lineitem", "orders", "customer", "nation", "part")),
    "sales_pipeline": (SALES_PIPELINE, ("orders", "customer")),
    "accounts": (ACCOUNTS, ("customer",)),
    "sales_teams": (SALES_TEAMS, ("orders",)),
    "employees": (EMPLOYEES, ("customer", "nation")),
}

SPARK_MINUTES = "make_dt_interval(0, 0, CAST(o.o_orderkey % 1440 AS INT))"


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named adapter view over the tables in a folder, as a lazy DataFrame."""
    text, tables = VIEWS[name]
    frames = {table: star_table(spark, folder, table) for table in tables}
    return spark.sql(text.replace("{MINUTES}", SPARK_MINUTES), **frames)
