"""Research tables as views over the test tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Prices are summed in whole cents, which is exact: a sum of doubles hangs on the order of its rows, so equal
#: prices of two tickers would differ in the last bit and a rank would break their tie by chance.
VIEWS = {
    "panel": "SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 100 + 10 * ln(CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity)) AS close, "
    "100 + 10 * ln(max(l_extendedprice / l_quantity)) AS high, 100 + 10 * ln(min(l_extendedprice / l_quantity)) AS low, sum(l_quantity) AS volume FROM {lineitem} GROUP BY 1, 2",
    "companies": "SELECT s_suppkey AS ticker, s_name AS company_name, r_name AS sector, n_name AS industry FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "daily": "SELECT user_id AS ticker, CAST(ts AS DATE) AS date, 100 + avg(value) AS close, count(*) AS volume FROM {events} GROUP BY 1, 2",
    "news": "SELECT user_id AS ticker, ts, event_id, event_type AS title, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'bullish' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS sentiment FROM {events}",
    "facts": "SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, sum(l_extendedprice * (1 - l_discount)) AS val, "
    "CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH + INTERVAL 34 DAY AS DATE) AS filed FROM {lineitem} GROUP BY 1, 2, 4",
    "macro": "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10000 AS vix, 2.0 + avg(o_custkey % 10) / 10 AS tbill_3m FROM {orders} GROUP BY 1",
    "insiders": "SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS filed, l_orderkey AS accession, CASE l_returnflag WHEN 'A' THEN 'P' ELSE 'S' END AS code, l_extendedprice AS value FROM {lineitem} WHERE l_returnflag IN ('A', 'R')",
    "membership": "SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '1995-06-01' + CAST(s_suppkey % 365 AS INT) END AS start_date, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2000-01-01' + CAST(s_suppkey % 365 AS INT) END AS end_date FROM {supplier}",
    "changes": "SELECT CAST(ts AS DATE) AS date, user_id AS ticker, min(CASE event_type WHEN 'signup' THEN 'added' ELSE 'removed' END) AS kind FROM {events} WHERE event_type IN ('signup', 'error') GROUP BY 1, 2",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_sql(*names: str) -> str:
    """A WITH clause of the views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
