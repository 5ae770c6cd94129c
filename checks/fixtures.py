"""Messy views over the given tables, and the SQL fragments the oracles share.

Each view is one SQL text that runs unchanged in Spark and in DuckDB over the whole base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, tables: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (tables, sql.strip())


_view("messy_customer", ("customer",), """
SELECT c_custkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'N/A'
       WHEN c_custkey % 5 = 0 THEN concat('  ', upper(c_name), '   x ') ELSE c_name END AS name,
  CASE WHEN c_custkey % 17 = 0 THEN 'unknown' WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
       WHEN c_custkey % 3 = 1 THEN concat(' ', c_mktsegment) ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 19 = 0 THEN '-' WHEN c_custkey % 23 = 0 THEN 'abc'
       WHEN c_custkey % 29 = 0 THEN '12,345.50'
       WHEN c_custkey % 2 = 0 THEN concat('$', CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING))
       ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END AS balance_text,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
  CASE WHEN c_custkey % 31 = 0 THEN 'not-an-email' WHEN c_custkey % 37 = 0 THEN NULL
       ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 4 = 0 THEN 'Yes' WHEN c_custkey % 4 = 1 THEN 'n'
       WHEN c_custkey % 4 = 2 THEN 'TRUE' ELSE '0' END AS active,
  CAST(NULL AS STRING) AS empty_col, 'k' AS const_col, c_mktsegment AS seg_a, c_mktsegment AS seg_b
FROM customer
""")

_view("messy_orders", ("orders",), """
SELECT o_orderkey, o_custkey, o_totalprice,
  CASE WHEN o_orderkey % 41 = 0 THEN 'not a date' WHEN o_orderkey % 43 = 0 THEN 'n/a'
       WHEN o_orderkey % 47 = 0 THEN '2099-01-01'
       WHEN o_orderkey % 3 = 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-',
         lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
       WHEN o_orderkey % 3 = 1 THEN concat(CAST(month(o_orderdate) AS STRING), '/',
         CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
       ELSE concat(CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING), '-',
         CAST(year(o_orderdate) AS STRING)) END AS date_text,
  concat(o_orderpriority, '|', o_orderstatus) AS prio_status
FROM orders
""")

# Every event twice; every ninth copy is an exact repeat, the others get an id of their own.
_view("messy_dups", ("events",), """
SELECT event_id, user_id, event_type, value, event_id AS seq FROM events
UNION ALL
SELECT CASE WHEN event_id % 9 = 0 THEN event_id ELSE -1 - event_id END AS event_id, user_id, event_type, value,
  event_id + 1000000000000 AS seq FROM events
""")

_view("gappy_events", ("events",), """
SELECT event_id, user_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE event_type END AS event_type FROM events
""")

_view("outlier_parts", ("part",), """
SELECT p_partkey, p_brand,
  CASE WHEN p_partkey % 401 = 0 THEN p_retailprice * 50 ELSE p_retailprice END AS price FROM part
""")

# Text keys with spaces, repeated keys, keys only on this side, and missing keys.
_view("crm_right", ("customer",), """
SELECT CASE WHEN c_custkey % 100 = 51 THEN 'n/a' WHEN c_custkey % 100 = 53 THEN NULL
    WHEN c_custkey % 25 = 1 THEN CAST(c_custkey + 1000000000000 AS STRING)
    WHEN c_custkey % 10 = 7 THEN CAST(c_custkey - 1 AS STRING)
    ELSE concat(' ', CAST(c_custkey AS STRING)) END AS cust_ref,
  c_mktsegment AS segment, c_nationkey AS nation FROM customer
""")

# Same people under normalised names; missing names are written differently than on the left side.
_view("crm_names", ("customer",), """
SELECT c_custkey AS ref,
  CASE WHEN c_custkey % 11 = 0 THEN '--' WHEN c_custkey % 13 = 0 THEN NULL ELSE concat(upper(c_name), ' ') END AS full_name,
  c_nationkey AS nation FROM customer
""")

# Left keys that repeat and go missing.
_view("customer_refs", ("customer",), """
SELECT c_custkey AS id, CASE WHEN c_custkey % 200 = 3 THEN 'None' WHEN c_custkey % 10 = 9 THEN CAST(c_custkey - 1 AS STRING)
    ELSE CAST(c_custkey AS STRING) END AS ref, c_acctbal AS balance FROM customer
""")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the messy views over it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    bases, sql = VIEWS[name]
    for base in bases:
        table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the views it reads."""
    parts = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    return f"WITH {parts} {sql}"


TOKENS_SQL = "('', 'null', 'none', 'nan', 'n/a', 'na', 'unknown', 'not available', '#n/a', '-', '--')"


def missing_sql(x: str) -> str:
    return f"({x} IS NULL OR lower(trim({x})) IN {TOKENS_SQL})"


def number_sql(x: str) -> str:
    grammar = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return f"CASE WHEN regexp_full_match(trim({x}), '{grammar}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def double_text_sql(x: str) -> str:
    return rf"regexp_replace(CAST({x} AS VARCHAR), '\.0$', '')"


def date_sql(x: str) -> str:
    return (
        rf"CASE WHEN regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_strptime({x}, '%Y-%m-%d') "
        rf"WHEN regexp_full_match({x}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN try_strptime({x}, '%m/%d/%Y') "
        rf"WHEN regexp_full_match({x}, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') THEN try_strptime({x}, '%m-%d-%Y') END"
    )
