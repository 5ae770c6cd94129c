"""Sorting, profiles, quality and outliers."""

from pyspark.sql import functions as F

import millrace as mr
from checks.fixtures import double_text_sql, missing_sql, number_sql
from checks.registry import check
from millrace.operators.ordering import number_rows

# --- sort (the position is part of the result, so the order itself is checked) -----------------------------------


@check(
    "sort_numeric_missing_last",
    "messy_customer",
    """SELECT *, row_number() OVER (ORDER BY acctbal IS NULL, acctbal DESC, c_custkey) AS pos FROM messy_customer""",
)
def _(df):
    return number_rows(df, [("acctbal", "desc")], "c_custkey", buckets=8)


@check(
    "sort_natural",
    "part",
    r"""SELECT *, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '\d+') AS INTEGER), p_partkey) AS pos
    FROM part""",
)
def _(df):
    return number_rows(df, [("p_brand", "asc")], "p_partkey", buckets=8)


@check(
    "sort_multi",
    "messy_customer",
    f"""SELECT *, row_number() OVER (ORDER BY {missing_sql('segment')},
    CASE WHEN NOT {missing_sql('segment')} THEN lower(segment) END, acctbal IS NULL, acctbal DESC, c_custkey) AS pos FROM messy_customer""",
)
def _(df):
    return number_rows(df, ["segment", ("acctbal", "desc")], "c_custkey", buckets=8)


@check(
    "page_rows",
    "messy_customer",
    """SELECT * FROM messy_customer ORDER BY acctbal IS NULL, acctbal, c_custkey LIMIT 50 OFFSET 100""",
)
def _(df):
    return mr.page(df, ["acctbal"], "c_custkey", n=2)


# --- profiles ---------------------------------------------------------------------------------------------------

_COLUMNS = [
    ("c_custkey", "integer"), ("name", "string"), ("segment", "string"), ("balance_text", "string"),
    ("acctbal", "decimal"), ("email", "string"), ("active", "string"), ("empty_col", "string"), ("const_col", "string"),
    ("seg_a", "string"), ("seg_b", "string"),
]


def _profile_sql(i: int, c: str, type: str, view: str) -> str:
    numeric = type in ("integer", "decimal")
    missing = f"{c} IS NULL" if numeric else missing_sql(c)
    lo, hi = (f"{double_text_sql(f'CAST({f}({c}) AS DOUBLE)')}" if numeric else "CAST(NULL AS VARCHAR)" for f in ("min", "max"))
    text = double_text_sql(f"CAST({c} AS DOUBLE)") if numeric else c
    return f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{type}' AS "type", mc AS missing_count,
      round(mc / total, 9) AS missing_pct, uc AS unique_count, lo AS "min", hi AS "max",
      round(greatest(0.0, 1 - mc / total * 0.8 - CASE WHEN uc = 1 THEN 0.15 ELSE 0.0 END), 9) AS quality, ex AS examples FROM (
      SELECT count(*) AS total, count(*) FILTER (WHERE {missing}) AS mc, count(DISTINCT {c}) FILTER (WHERE NOT ({missing})) AS uc,
        {lo} AS lo, {hi} AS hi, (SELECT coalesce(string_agg(t, ';' ORDER BY k), '') FROM (SELECT {text} AS t, c_custkey AS k FROM {view}
        WHERE NOT ({missing}) ORDER BY c_custkey LIMIT 3)) AS ex FROM {view})"""


@check(
    "profile_columns",
    "messy_customer",
    "SELECT * FROM (" + " UNION ALL ".join(_profile_sql(i, c, t, "messy_customer") for i, (c, t) in enumerate(_COLUMNS)) + ")",
)
def profile_columns(df):
    profile = mr.profile_columns(df, order_by="c_custkey")
    return profile.withColumns(
        {
            "missing_pct": F.round("missing_pct", 9),
            "quality": F.round("quality", 9),
            "examples": F.array_join("examples", ";"),
        }
    )


@check(
    "profile_dataset",
    "messy_dups",
    """SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count,
    round(count(*) FILTER (WHERE event_type = 'click') / (count(*) * 4), 9) AS missing_cell_pct,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT event_id, user_id, event_type, value FROM messy_dups)) AS BIGINT)
    AS duplicate_row_count FROM messy_dups""",
)
def _(df):
    marked = df.drop("seq").withColumn("event_type", F.when(F.col("event_type") == "click", "N/A").otherwise(F.col("event_type")))
    return mr.profile_dataset(marked).withColumn("missing_cell_pct", F.round("missing_cell_pct", 9))


_NO_COMMAS = "replace(trim(balance_text), ',', '')"


def _quality_sql(cap: str) -> str:
    miss = " + ".join(f"CAST({missing_sql(c)} AS INTEGER)" for c in _SCORED)
    bad_number = f"NOT {missing_sql('balance_text')} AND ({number_sql(_NO_COMMAS)}) IS NULL"
    bad_segment = f"NOT {missing_sql('segment')} AND ({number_sql('segment')}) IS NULL"
    return f"""SELECT CAST(floor(greatest(0.0, 1.0 - m * 0.4 - d * 0.25 - i * 0.2 - t * 0.15) * 100 + 0.5) AS BIGINT) AS score,
      round(m, 9) AS missing_pct, round(d, 9) AS duplicate_pct, round(i, 9) AS invalid_pct, round(t, 9) AS type_issue_pct FROM (
      SELECT sum({miss}) / (count(*) * 4) AS m,
        1 - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_SCORED)} FROM messy_customer)) / count(*) AS d,
        {cap.format(f"count(*) FILTER (WHERE {bad_number})")} / (count(*) * 4) AS i,
        {cap.format(f"count(*) FILTER (WHERE {bad_segment})")} / (count(*) * 4) AS t FROM messy_customer)"""


_SCORED = ["segment", "balance_text", "active", "const_col"]
_TYPES = {"balance_text": ("decimal", False), "segment": ("integer", True), "active": ("boolean", False)}
for _name, _cap, _limit in (("quality_score", "least(20, {})", 20), ("quality_score_uncapped", "{}", None)):

    @check(_name, "messy_customer", _quality_sql(_cap))
    def _(df, limit=_limit):
        score = mr.quality_score(df.select(*_SCORED), _TYPES, cap=limit)
        return score.select("score", *[F.round(c, 9).alias(c) for c in score.columns if c != "score"])


# --- outliers ---------------------------------------------------------------------------------------------------

_IQR = """bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
  SELECT max(price) FILTER (WHERE r = CAST(floor(n * 0.25) AS BIGINT) + 1) AS q1, max(price) FILTER (WHERE r = CAST(floor(n * 0.75) AS BIGINT) + 1) AS q3
  FROM (SELECT price, row_number() OVER (ORDER BY price) AS r, count(*) OVER () AS n FROM outlier_parts)))"""


@check(
    "outliers_iqr",
    "outlier_parts",
    f", {_IQR} SELECT p_partkey, p_brand, price, round(low, 6) AS low, round(high, 6) AS high FROM outlier_parts, bounds WHERE price < low OR price > high",
)
def _(df):
    found = mr.detect_outliers(df, "price", "iqr")
    return found.rows.withColumns({"low": F.round(F.lit(found.low), 6), "high": F.round(F.lit(found.high), 6)})


@check(
    "outliers_zscore",
    "outlier_parts",
    """SELECT p_partkey, p_brand, price FROM outlier_parts, (SELECT avg(price) AS mean, stddev_pop(price) AS std FROM outlier_parts)
    WHERE abs((price - mean) / std) > 3""",
)
def _(df):
    return mr.detect_outliers(df, "price", "zscore").rows


@check("remove_outliers", "outlier_parts", f", {_IQR} SELECT p_partkey, p_brand, price FROM outlier_parts, bounds WHERE NOT (price < low OR price > high)")
def _(df):
    return mr.remove_outliers(df, "price", "iqr")
