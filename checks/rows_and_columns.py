"""Row filters, duplicates and column operators."""

from pyspark.sql import functions as F

import millrace as mr
from checks.fixtures import double_text_sql, missing_sql, number_sql
from checks.registry import check

# --- row filters ------------------------------------------------------------------------------------------------

_TEXT_EQ = f"NOT {missing_sql('segment')} AND lower(segment)"
_BAL = number_sql("balance_text")
_PREDICATES = {
    "eq": (("segment", "eq", "building"), f"{_TEXT_EQ} = 'building'"),
    "neq": (("segment", "neq", "building"), f"{_TEXT_EQ} <> 'building'"),
    "gt": (("balance_text", "gt", "5000"), f"({_BAL}) > 5000"),
    "lt": (("acctbal", "lt", ""), "acctbal < 0"),
    "gte": (("c_custkey", "gte", "700"), "c_custkey >= 700"),
    "lte": (("acctbal", "lte", "1863.84"), "acctbal <= 1863.84"),
    "contains": (("name", "contains", "OMER#0000001"), f"NOT {missing_sql('name')} AND contains(lower(name), 'omer#0000001')"),
    "startswith": (("segment", "startswith", "MAC"), f"NOT {missing_sql('segment')} AND starts_with(lower(segment), 'mac')"),
    "endswith": (("acctbal", "endswith", ".5"), f"acctbal IS NOT NULL AND suffix({double_text_sql('acctbal')}, '.5')"),
    "empty": (("name", "empty"), missing_sql("name")),
    "notempty": (("name", "notempty"), f"NOT {missing_sql('name')}"),
}

for _op, (_rule, _where) in _PREDICATES.items():
    check(f"pred_{_op}", "messy_customer", f"SELECT * FROM messy_customer WHERE {_where}")(
        lambda df, rule=_rule: mr.filter_rows(df, [rule])
    )

_BOTH = [{"column": "segment", "op": "contains", "value": "build"}, {"column": "acctbal", "op": "gt", "value": "0"}]
_BOTH_SQL = f"NOT {missing_sql('segment')} AND contains(lower(segment), 'build')", "coalesce(acctbal > 0, FALSE)"


@check("filter_and", "messy_customer", f"SELECT * FROM messy_customer WHERE ({_BOTH_SQL[0]}) AND ({_BOTH_SQL[1]})")
def _(df):
    return mr.filter_rows(df, _BOTH, "AND")


@check("filter_or", "messy_customer", f"SELECT * FROM messy_customer WHERE ({_BOTH_SQL[0]}) OR ({_BOTH_SQL[1]})")
def _(df):
    return mr.filter_rows(df, _BOTH, "OR")


@check("remove_matching", "messy_customer", f"SELECT * FROM messy_customer WHERE NOT (({_BOTH_SQL[0]}) AND ({_BOTH_SQL[1]}))")
def _(df):
    return mr.remove_rows_matching(df, _BOTH, "AND")


@check(
    "remove_empty_rows",
    "messy_customer",
    f"SELECT name, segment FROM messy_customer WHERE NOT ({missing_sql('name')} AND {missing_sql('segment')})",
)
def _(df):
    return mr.remove_empty_rows(df.select("name", "segment"))


_WITHOUT_EMPTY = "c_custkey, name, segment, balance_text, acctbal, email, active"
_ANY = " OR ".join([*(missing_sql(c) for c in ("name", "segment", "balance_text", "email", "active")), "acctbal IS NULL"])


@check("drop_missing_any", "messy_customer", f"SELECT {_WITHOUT_EMPTY} FROM messy_customer WHERE NOT ({_ANY})")
def _(df):
    return mr.remove_rows_with_missing(df.select(*_WITHOUT_EMPTY.split(", ")))


@check(
    "drop_missing_subset",
    "messy_customer",
    f"SELECT * FROM messy_customer WHERE NOT ({missing_sql('name')} OR acctbal IS NULL)",
)
def _(df):
    return mr.remove_rows_with_missing(df, ["name", "acctbal"])


@check(
    "remove_rows_by_key",
    ("messy_customer", "orders"),
    "SELECT * FROM messy_customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def _(df, orders):
    bad = mr.filter_rows(orders, [("o_totalprice", "gt", "300000")]).select(F.col("o_custkey").alias("c_custkey"))
    return mr.remove_rows_by_key(df, bad, "c_custkey")


_HIT = " OR ".join(
    f"contains(lower(coalesce({c}, '')), '99')" for c in ("name", "segment", "balance_text", "email", "active")
)


@check(
    "search_rows",
    "messy_customer",
    f"SELECT * FROM messy_customer WHERE contains(CAST(c_custkey AS VARCHAR), '99') OR {_HIT}"
    " OR contains(concat_ws(' ', empty_col, const_col, seg_a, seg_b), '99')"
    f" OR contains(coalesce({double_text_sql('acctbal')}, ''), '99')",
)
def _(df):
    return mr.search_rows(df, " 99 ")


# --- duplicates -------------------------------------------------------------------------------------------------

_KEYS = ["event_id", "user_id", "event_type", "value"]


@check(
    "count_dups_all",
    "messy_dups",
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_id, user_id, event_type, value FROM messy_dups))"
    " AS BIGINT) AS duplicates FROM messy_dups",
)
def _(df):
    return mr.count_duplicates(df, _KEYS)


@check(
    "count_dups_subset",
    "messy_dups",
    "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM messy_dups)) AS BIGINT)"
    " AS duplicates FROM messy_dups",
)
def _(df):
    return mr.count_duplicates(df, ["user_id", "event_type"])


def _ranked(keys: str, direction: str) -> str:
    return (
        "SELECT event_id, user_id, event_type, value, seq FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY seq {direction}) AS r FROM messy_dups) WHERE r = 1"
    )


@check("dedup_first", "messy_dups", _ranked(", ".join(_KEYS), "ASC"))
def _(df):
    return mr.drop_duplicates(df, keep="first", order_by="seq")


@check("dedup_last", "messy_dups", _ranked(", ".join(_KEYS), "DESC"))
def _(df):
    return mr.drop_duplicates(df, keep="last", order_by="seq")


@check("dedup_subset", "messy_dups", _ranked("user_id, event_type", "ASC"))
def _(df):
    return mr.drop_duplicates(df, ["user_id", "event_type"], "first", "seq")


# --- columns ----------------------------------------------------------------------------------------------------

_ALL = "c_custkey, name, segment, balance_text, acctbal, email, active, empty_col, const_col, seg_a, seg_b"


def _without(*names: str) -> str:
    return ", ".join(c for c in _ALL.split(", ") if c not in names)


@check("drop_columns", "messy_customer", f"SELECT {_without('email', 'seg_b')} FROM messy_customer")
def _(df):
    return mr.remove_columns(df, ["email", "seg_b", "no_such_column"])


@check("drop_empty_columns", "messy_customer", f"SELECT {_without('empty_col')} FROM messy_customer")
def _(df):
    return mr.remove_empty_columns(df)


@check("drop_sparse_columns", "gappy_events", "SELECT event_id, user_id, event_type FROM gappy_events")
def _(df):
    return mr.remove_sparse_columns(df, 0.5)


@check("drop_constant_columns", "messy_customer", f"SELECT {_without('const_col')} FROM messy_customer")
def _(df):
    return mr.remove_constant_columns(df)


@check("drop_duplicate_columns", "messy_customer", f"SELECT {_without('seg_b')} FROM messy_customer")
def _(df):
    return mr.remove_duplicate_columns(df)


def _reason_sql(c: str, view: str, text: bool) -> str:
    miss = missing_sql(c) if text else f"{c} IS NULL"
    return f"""SELECT '{c}' AS "column", CASE
      WHEN count(*) FILTER (WHERE {miss}) = count(*) THEN 'entirely empty'
      WHEN count(DISTINCT {c}) FILTER (WHERE NOT ({miss})) <= 1 THEN 'constant value'
      WHEN count(*) FILTER (WHERE {miss}) >= 0.9 * count(*)
        THEN concat(CAST(CAST(floor(100.0 * count(*) FILTER (WHERE {miss}) / count(*) + 0.5) AS BIGINT) AS VARCHAR), '% missing')
      WHEN starts_with(lower('{c}'), 'unnamed') THEN 'looks like an index artifact' END AS reason FROM {view}"""


_SUGGEST = """suggestable AS (SELECT *, CASE WHEN c_custkey % 20 = 1 THEN name ELSE 'n/a' END AS mostly_missing,
  c_custkey AS "Unnamed_0" FROM messy_customer)"""
_SUGGESTIONS = " UNION ALL ".join(
    _reason_sql(c, "suggestable", c not in ("c_custkey", "acctbal", '"Unnamed_0"')).replace("'\"Unnamed_0\"'", "'Unnamed_0'")
    for c in [*_ALL.split(", "), "mostly_missing", '"Unnamed_0"']
)


@check(
    "suggest_columns",
    "messy_customer",
    f", {_SUGGEST} SELECT * FROM ({_SUGGESTIONS}) WHERE reason IS NOT NULL",
)
def _(df):
    sparse = F.when(F.col("c_custkey") % 20 == 1, F.col("name")).otherwise("n/a")
    wider = df.withColumn("mostly_missing", sparse).withColumn("Unnamed_0", F.col("c_custkey"))
    return mr.suggest_unnecessary_columns(wider)


@check("rename_column", "messy_customer", f"SELECT c_custkey, name AS full_name, {_without('c_custkey', 'name')} FROM messy_customer")
def _(df):
    return mr.rename_column(df, "name", "full_name")


@check(
    "snake_case_columns",
    "customer",
    'SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS acct_balance_usd, c_mktsegment AS full_name_2 FROM customer',
)
def _(df):
    named = df.select(
        F.col("c_custkey").alias(" customerKey "),
        F.col("c_name").alias("Full Name"),
        F.col("c_acctbal").alias("acct-balance (USD)"),
        F.col("c_mktsegment").alias("fullName"),
    )
    return mr.normalize_column_names(named)


@check("reorder_columns", "messy_customer", "SELECT email, c_custkey, name FROM messy_customer")
def _(df):
    return mr.reorder_columns(df, ["email", "no_such_column", "c_custkey", "name"])


@check(
    "split_column",
    "messy_orders",
    """SELECT o_orderkey, o_custkey, o_totalprice, date_text, prio_status, trim(string_split(prio_status, '|')[1]) AS prio,
    trim(string_split(prio_status, '|')[2]) AS status, CAST(NULL AS VARCHAR) AS extra FROM messy_orders""",
)
def _(df):
    return mr.split_column(df, "prio_status", "|", ["prio", "status", "extra"])


@check(
    "combine_columns",
    "messy_customer",
    f"""SELECT *, concat_ws(' / ', CASE WHEN NOT {missing_sql('name')} THEN name END,
    CASE WHEN NOT {missing_sql('segment')} THEN segment END, {double_text_sql('acctbal')}) AS combined FROM messy_customer""",
)
def _(df):
    return mr.combine_columns(df, ["name", "segment", "acctbal"], "combined", " / ")

# --- orders and names that are easy to get wrong ----------------------------------------------------------------

_NULL_ORDER = "SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS place, user_id, event_id % 3 AS part, value FROM events"
check(
    "dedup_null_order",
    "events",
    f"""WITH e AS ({_NULL_ORDER}), m AS (
      SELECT place, user_id, part, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, part, value ORDER BY place NULLS FIRST) = 1)
    SELECT * FROM m""",
)(
    lambda df: mr.drop_duplicates(
        df.select(F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("place"), "user_id", (F.col("event_id") % 3).alias("part"), "value"),
        keys=["user_id", "part", "value"],
        order_by="place",
    )
)

_GAPS = "SELECT event_id, CASE WHEN event_id > 0 THEN event_id END AS place, CASE WHEN event_id % 5 = 0 THEN value END AS v FROM events"
_CARRIED = f"""WITH e AS ({_GAPS})
  SELECT event_id, place, last_value(v IGNORE NULLS) OVER (ORDER BY place NULLS FIRST ROWS UNBOUNDED PRECEDING) AS v FROM e"""
for _ranges in (1, 16):
    check(f"fill_previous_null_order_{_ranges}", "events", _CARRIED)(
        lambda df, ranges=_ranges: mr.fill_missing(
            df.select(
                "event_id",
                F.when(F.col("event_id") > 0, F.col("event_id")).alias("place"),
                F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("v"),
            ),
            "v",
            "previous",
            order_by="place",
            buckets=ranges,
        )
    )

check("dups_column_n", "events", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id % 50 FROM events)) AS duplicates FROM events")(
    lambda df: mr.count_duplicates(df.select(F.col("event_type").alias("N"), (F.col("user_id") % 50).alias("n_")).withColumnRenamed("n_", "_n"))
)
