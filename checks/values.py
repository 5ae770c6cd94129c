"""Fills, text, numbers, dates and types."""

from pyspark.sql import functions as F

import millrace as mr
from checks.fixtures import date_sql, double_text_sql, missing_sql, number_sql
from checks.registry import check

# --- missing values ---------------------------------------------------------------------------------------------


@check(
    "count_missing",
    "messy_customer",
    f"""SELECT count(*) FILTER (WHERE {missing_sql('name')}) AS name,
    count(*) FILTER (WHERE {missing_sql('segment')}) AS segment, count(*) FILTER (WHERE acctbal IS NULL) AS acctbal
    FROM messy_customer""",
)
def _(df):
    return mr.count_missing(df, ["name", "segment", "acctbal"])


@check(
    "fill_mean",
    "messy_customer",
    "SELECT c_custkey, round(coalesce(acctbal, (SELECT avg(acctbal) FROM messy_customer)), 4) AS acctbal FROM messy_customer",
)
def _(df):
    filled = mr.fill_missing(df.select("c_custkey", "acctbal"), "acctbal", "mean")
    return filled.withColumn("acctbal", F.round("acctbal", 4))


@check(
    "fill_median",
    "messy_customer",
    "SELECT c_custkey, round(coalesce(acctbal, (SELECT median(acctbal) FROM messy_customer)), 4) AS acctbal FROM messy_customer",
)
def _(df):
    filled = mr.fill_missing(df.select("c_custkey", "acctbal"), "acctbal", "median")
    return filled.withColumn("acctbal", F.round("acctbal", 4))


@check(
    "fill_mode",
    "gappy_events",
    f"""SELECT event_id, user_id, value, CASE WHEN {missing_sql('event_type')} THEN (SELECT event_type FROM gappy_events
    WHERE NOT {missing_sql('event_type')} GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 1)
    ELSE event_type END AS event_type FROM gappy_events""",
)
def _(df):
    return mr.fill_missing(df, "event_type", "mode", order_by="event_id")


@check(
    "fill_zero",
    "messy_customer",
    f"""SELECT c_custkey, coalesce(acctbal, 0) AS acctbal,
    CASE WHEN {missing_sql('balance_text')} THEN '0' ELSE balance_text END AS balance_text FROM messy_customer""",
)
def _(df):
    df = mr.fill_missing(df.select("c_custkey", "acctbal", "balance_text"), "acctbal", "zero")
    return mr.fill_missing(df, "balance_text", "zero")


@check(
    "fill_custom",
    "messy_customer",
    f"""SELECT c_custkey, CASE WHEN {missing_sql('segment')} THEN 'OTHER' ELSE segment END AS segment FROM messy_customer""",
)
def _(df):
    return mr.fill_missing(df.select("c_custkey", "segment"), "segment", "custom", "OTHER")


def _carry_sql(c: str, direction: str, partition: str = "") -> str:
    pick, order = ("last_value", "ASC") if direction == "previous" else ("last_value", "DESC")
    return (
        f"coalesce({c}, {pick}({c} IGNORE NULLS) OVER ({partition} ORDER BY event_id {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    )


for _dir in ("previous", "next"):
    check(
        f"fill_{_dir}",
        "gappy_events",
        f"SELECT event_id, user_id, {_carry_sql('value', _dir)} AS value, event_type FROM gappy_events",
    )(lambda df, d=_dir: mr.fill_missing(df, "value", d, order_by="event_id", buckets=16))


@check(
    "fill_previous_by_user",
    "gappy_events",
    f"""SELECT event_id, user_id, value, coalesce({_carry_sql('present', 'previous', 'PARTITION BY user_id')}, event_type)
    AS event_type FROM (SELECT *, CASE WHEN NOT {missing_sql('event_type')} THEN event_type END AS present FROM gappy_events)""",
)
def _(df):
    return mr.fill_missing(df, "event_type", "previous", order_by="event_id", partition_by=["user_id"], buckets=16)


# --- text -------------------------------------------------------------------------------------------------------

_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_NOT_SPACE = _SPACE.replace("[", "[^", 1)
_TITLE = rf"""array_to_string(list_transform(regexp_extract_all(text, '\W*\w{_NOT_SPACE}*|\W+'), lambda p:
  concat(regexp_extract(p, '^\W*'), upper(substr(p, length(regexp_extract(p, '^\W*')) + 1, 1)),
  lower(substr(p, length(regexp_extract(p, '^\W*')) + 2)))), '')"""
_TEXT_OPS = {
    "trim": ("trim", rf"regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')"),
    "lower": ("lowercase", "lower(text)"),
    "upper": ("uppercase", "upper(replace(text, 'ß', 'SS'))"),
    "title": ("titlecase", _TITLE),
    "punct": ("remove_punctuation", r"""regexp_replace(text, '[!-\[\]-/:-@^-`{-~]', '', 'g')""".replace(
        r"[!-\[\]-/:-@^-`{-~]", r"[!-/:-@\[\]^_`{-~]")),
    "special": ("remove_special", rf"regexp_replace(text, '[^\w{_SPACE[1:]}', '', 'g')"),
}

for _name, (_text_op, _sql) in _TEXT_OPS.items():
    check(
        f"text_{_name}",
        "documents",
        f"SELECT doc_id, CASE WHEN {missing_sql('text')} THEN text ELSE {_sql} END AS text FROM documents",
    )(lambda df, op=_text_op: mr.clean_text(df.select("doc_id", "text"), "text", op))


@check("find_replace_literal", "documents", "SELECT doc_id, replace(text, 'a.', '[$1]') AS text FROM documents")
def _(df):
    return mr.find_replace(df.select("doc_id", "text"), "text", "a.", "[$1]")


@check(
    "find_replace_regex",
    "documents",
    r"SELECT doc_id, regexp_replace(text, '([a-z]+)-(\d+)', '\2$\1<\0>', 'g') AS text FROM documents",
)
def _(df):
    return mr.find_replace(df.select("doc_id", "text"), "text", r"([a-z]+)-(\d+)", "$2$$$1<$&>", regex=True)


_MAPPING = {" Building ": "construction", "MACHINERY": "machines", "automobile": "", "Household": "home"}


@check(
    "standardize_categories",
    "messy_customer",
    f"""SELECT c_custkey, CASE WHEN {missing_sql('segment')} THEN segment WHEN lower(trim(segment)) = 'building' THEN 'construction'
    WHEN lower(trim(segment)) = 'machinery' THEN 'machines' WHEN lower(trim(segment)) = 'household' THEN 'home'
    ELSE segment END AS segment FROM messy_customer""",
)
def _(df):
    return mr.standardize_categories(df.select("c_custkey", "segment"), "segment", _MAPPING)


@check(
    "distinct_values",
    "messy_customer",
    """SELECT balance_text AS value, count(*) AS n FROM messy_customer WHERE trim(balance_text) <> ''
    GROUP BY balance_text ORDER BY balance_text LIMIT 30""",
)
def _(df):
    return mr.distinct_values(df, "balance_text", 30)


# --- numbers ----------------------------------------------------------------------------------------------------

_STRIPPED = r"replace(regexp_replace(trim(balance_text), '[^\d.,\-]', '', 'g'), ',', '')"
_CLEANED = f"""CASE WHEN {missing_sql('balance_text')} THEN NULL WHEN {_STRIPPED} = '' THEN 0.0
  ELSE {number_sql(_STRIPPED)} END"""


@check(
    "clean_numbers",
    "messy_customer",
    f"""SELECT c_custkey, CASE WHEN {missing_sql('balance_text')} THEN NULL
    ELSE {number_sql("replace(trim(balance_text), ',', '')")} END AS balance,
    CASE WHEN NOT {missing_sql('balance_text')} AND ({number_sql("replace(trim(balance_text), ',', '')")}) IS NULL
    THEN balance_text END AS rescued FROM messy_customer""",
)
def _(df):
    cleaned = mr.clean_numbers(df.select("c_custkey", "balance_text"), "balance_text", commas=True)
    return cleaned.select("c_custkey", F.col("balance_text").alias("balance"), F.col("_rescued")["balance_text"].alias("rescued"))


@check("clean_numbers_round", "messy_customer", f"SELECT c_custkey, round({_CLEANED}, 0) AS balance FROM messy_customer")
def _(df):
    cleaned = mr.clean_numbers(df, "balance_text", commas=True, currency=True, round=0, on_invalid="null")
    return cleaned.select("c_custkey", F.col("balance_text").alias("balance"))


@check(
    "clean_percent",
    "lineitem",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_discount * 100, 0) AS BIGINT) AS discount FROM lineitem""",
)
def _(df):
    percent = F.concat(F.round(F.col("l_discount") * 100, 0).cast("bigint").cast("string"), F.lit(" %"))
    keyed = df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", percent.alias("discount"))
    cleaned = mr.clean_numbers(keyed, "discount", percent=True, on_invalid="null")
    return cleaned.withColumn("discount", F.col("discount").cast("bigint"))


# --- dates ------------------------------------------------------------------------------------------------------

_DATE = date_sql("date_text")
for _name, _fmt, _strf in (("iso", "YYYY-MM-DD", "%Y-%m-%d"), ("dmy", "DD-MM-YYYY", "%d-%m-%Y"), ("mdy", "MM/DD/YYYY", "%m/%d/%Y")):
    check(
        f"dates_{_name}",
        "messy_orders",
        f"""SELECT o_orderkey, CASE WHEN {missing_sql('date_text')} THEN date_text
        ELSE coalesce(strftime({_DATE}, '{_strf}'), date_text) END AS date_text FROM messy_orders""",
    )(lambda df, f=_fmt: mr.standardize_dates(df.select("o_orderkey", "date_text"), "date_text", f))


@check(
    "date_parts",
    "messy_orders",
    f"""SELECT o_orderkey, CAST(year(d) AS INTEGER) AS date_text_year, CAST(month(d) AS INTEGER) AS date_text_month,
    CAST(day(d) AS INTEGER) AS date_text_day, dayname(d) AS date_text_weekday, date_text
    FROM (SELECT *, {_DATE} AS d FROM messy_orders)""",
)
def _(df):
    df = df.select("o_orderkey", "date_text")
    for part in ("year", "month", "day", "weekday"):
        df = mr.extract_date_part(df, "date_text", part)
    return df


# --- types ------------------------------------------------------------------------------------------------------


def _infer_sql(c: str, text: bool = True) -> str:
    present = f"NOT {missing_sql('v')}" if text else "v IS NOT NULL"
    value = c if text else double_text_sql(c)
    return rf"""SELECT '{c}' AS "column", CASE WHEN n = 0 THEN 'string' WHEN b >= 0.9 * n THEN 'boolean'
      WHEN i >= 0.9 * n THEN 'integer' WHEN i + d >= 0.9 * n THEN 'decimal' WHEN t >= 0.9 * n THEN 'date'
      WHEN u <= greatest(10, 0.05 * n) AND u < n THEN 'category' ELSE 'string' END AS "type" FROM (
      SELECT count(*) AS n, count(*) FILTER (WHERE vote = 'b') AS b, count(*) FILTER (WHERE vote = 'i') AS i,
        count(*) FILTER (WHERE vote = 'd') AS d, count(*) FILTER (WHERE vote = 't') AS t,
        count(DISTINCT lower(trim(v))) AS u FROM (
        SELECT v, CASE WHEN {str(text)} AND lower(trim(v)) IN ('true','yes','y','1','false','no','n','0') THEN 'b'
          WHEN regexp_full_match(trim(v), '-?\d+') THEN 'i' WHEN regexp_full_match(trim(v), '-?\d*\.\d+') THEN 'd'
          WHEN ({date_sql('trim(v)')}) IS NOT NULL THEN 't' ELSE 's' END AS vote
        FROM (SELECT {value} AS v FROM joined) WHERE {present}))"""


_INFERRED = ["name", "segment", "balance_text", "email", "active", "empty_col", "const_col", "date_text", "plain_text", "few"]
_JOINED = """joined AS (SELECT m.*, o.date_text, CASE WHEN o.o_orderkey % 20 = 0 THEN 'x' ELSE
  CAST(o.o_orderkey AS VARCHAR) END AS plain_text, o.prio_status AS few FROM messy_orders o JOIN messy_customer m
  ON o.o_custkey = m.c_custkey)"""


@check(
    "infer_types",
    ("messy_customer", "messy_orders"),
    f", {_JOINED} " + " UNION ALL ".join([*map(_infer_sql, _INFERRED), _infer_sql("acctbal", False), _infer_sql("c_custkey", False)]),
)
def _(customers, orders):
    plain = F.when(F.col("o_orderkey") % 20 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.withColumn("plain_text", plain).withColumn("few", F.col("prio_status"))
    labels = mr.infer_types(joined, [*_INFERRED, "acctbal", "c_custkey"])
    return joined.sparkSession.createDataFrame(list(labels.items()), "column string, type string")


def _convert(name: str, view: str, key: str, column: str, type: str, value_sql: str):
    @check(
        f"convert_{name}",
        view,
        f"""SELECT {key}, CASE WHEN NOT {missing_sql(column)} THEN {value_sql} END AS converted,
        CASE WHEN NOT {missing_sql(column)} AND ({value_sql}) IS NULL THEN {column} END AS rescued FROM {view}""",
    )
    def _(df):
        out = mr.convert_type(df.select(key, column), column, type)
        return out.select(key, F.col(column).alias("converted"), F.col("_rescued")[column].alias("rescued"))


_NO_COMMAS = number_sql("replace(trim(balance_text), ',', '')")
_convert("integer", "messy_customer", "c_custkey", "balance_text", "integer", f"CAST(trunc({_NO_COMMAS}) AS BIGINT)")
_convert("decimal", "messy_customer", "c_custkey", "balance_text", "decimal", f"({_NO_COMMAS})")
_convert(
    "boolean", "messy_customer", "c_custkey", "active", "boolean",
    "CASE WHEN lower(trim(active)) IN ('true','yes','y','1') THEN TRUE WHEN lower(trim(active)) IN ('false','no','n','0') THEN FALSE END",
)
_convert("date", "messy_orders", "o_orderkey", "date_text", "date", f"CAST(({_DATE}) AS DATE)")
_convert("string", "messy_customer", "c_custkey", "name", "string", "trim(name)")


@check(
    "invalid_values",
    "messy_customer",
    f"""SELECT balance_text AS value FROM messy_customer WHERE NOT {missing_sql('balance_text')}
    AND ({_NO_COMMAS}) IS NULL ORDER BY c_custkey LIMIT 20""",
)
def _(df):
    return mr.invalid_values(df, "balance_text", "decimal", "c_custkey")
