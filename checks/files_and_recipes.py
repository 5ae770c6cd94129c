"""Reading, writing, reports and recipes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

import millrace as mr
from checks.fixtures import VIEWS, date_sql, double_text_sql, missing_sql, table, with_views
from checks.registry import ORACLES, QUERIES, check
from checks.shipping import ship_code
from millrace.sources.delimited import sniff_delimiter
from millrace.sources.scratch import scratch_path, settled
from millrace.sources.workbooks import ROWS_PER_BATCH, workbook_rows
from millrace.streaming.replay import replay_stream

# --- round trips through files (in the session's shared folder) ---------------------------------------------------

_TEXT_COLUMNS = "name, segment, balance_text, email, active, empty_col, const_col, seg_a, seg_b"
_AS_TEXT = f"CAST(c_custkey AS VARCHAR) AS c_custkey, {_TEXT_COLUMNS}, {double_text_sql('acctbal')} AS acctbal"


@check("io_csv_roundtrip", "messy_customer", f"SELECT {_AS_TEXT} FROM messy_customer")
def _(df):
    path = scratch_path(df.sparkSession, "csv")
    mr.save_delimited(df, path)
    return mr.load_delimited(df.sparkSession, path, ",")


# Web pages hold quotes, tabs and line ends inside cells.
@check("io_tsv_roundtrip", "pages", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages")
def _(df):
    path = scratch_path(df.sparkSession, "tsv")
    mr.save_delimited(df, path, "\t")
    return mr.load_delimited(df.sparkSession, path, "\t")


@check(
    "io_txt_sniff",
    "messy_orders",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
    {double_text_sql('o_totalprice')} AS o_totalprice, date_text, prio_status, ';' AS detected FROM messy_orders""",
)
def _(df):
    path = scratch_path(df.sparkSession, "txt")
    mr.save_delimited(df, path, ";")
    return mr.load_delimited(df.sparkSession, path).withColumn("detected", F.lit(sniff_delimiter(df.sparkSession, path)))


_EMPTIED = ", ".join(f"coalesce({c}, '') AS {c}" for c in _TEXT_COLUMNS.split(", "))


@check(
    "io_json_roundtrip",
    "messy_customer",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_EMPTIED}, coalesce({double_text_sql('acctbal')}, '') AS acctbal
    FROM messy_customer""",
)
def _(df):
    path = scratch_path(df.sparkSession, "json")
    mr.save_json(df, path)
    return mr.load_json(df.sparkSession, path)


# {"rows": [...]} documents of at most 5,000 records: values keep their types, absent keys become null, nested values text.
@check(
    "io_json_wrapped",
    "customer",
    """SELECT c_custkey AS id, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name,
    concat('{"segment":"', c_mktsegment, '"}') AS more FROM customer""",
)
def _(df):
    record = F.struct(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"),
        F.struct(F.col("c_mktsegment").alias("segment")).alias("more"),
    )
    blocks = df.select(F.floor(F.col("c_custkey") / 5000).alias("block"), record.alias("r"))
    documents = blocks.groupBy("block").agg(F.collect_list("r").alias("rows"))
    path = scratch_path(df.sparkSession, "rows")
    documents.select(F.to_json(F.struct("rows")).alias("value")).write.text(path)
    return mr.load_json(df.sparkSession, path)


def _xlsx(header: list[str], rows: list[tuple]) -> bytes:
    """A minimal workbook with inline text and number cells, as test input for the reader."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    lines = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [header, *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One workbook per Arrow batch, so no workbook outgrows a batch."""
    for pdf in batches:
        if len(pdf):
            rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"path": [f"book-{pdf.iloc[0, 0]}"], "content": [_xlsx(list(pdf.columns), rows)]})


@check(
    "io_xlsx_load",
    "messy_customer",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, name, segment, balance_text, email FROM messy_customer",
)
def _(df):
    ship_code(df.sparkSession)
    source = df.select("c_custkey", "name", "segment", "balance_text", "email")
    # A small file is one task's, however many rows it holds: they are dealt out, and each workbook is made once.
    dealt = source.repartition(max(1, -(-source.count() // ROWS_PER_BATCH)))
    books = settled(dealt.mapInPandas(_books, "path string, content binary"), "workbooks")
    return workbook_rows(books).drop("source_file")


@check(
    "markdown_rows",
    "messy_orders",
    f"""SELECT concat('| ', CAST(o_orderkey AS VARCHAR), ' | ', CAST(o_custkey AS VARCHAR), ' | ', {double_text_sql('o_totalprice')},
    ' | ', date_text, ' | ', replace(prio_status, '|', '\\|'), ' |') AS line FROM messy_orders""",
)
def _(df):
    return mr.markdown_rows(df)


@check(
    "report_counts",
    "messy_customer",
    f"""SELECT count(*) AS original_rows, CAST(11 AS BIGINT) AS original_columns,
    count(*) FILTER (WHERE NOT {missing_sql('name')}) AS rows, CAST(10 AS BIGINT) AS columns FROM messy_customer""",
)
def _(df):
    cleaned = mr.remove_columns(mr.remove_rows_with_missing(df, ["name"]), ["empty_col"])
    return mr.report_counts(df, cleaned)


# --- recipes ----------------------------------------------------------------------------------------------------

ROW_RECIPE = (
    mr.Recipe()
    .add("remove_rows_with_missing", columns=["name"])
    .add("fill_missing", column="segment", strategy="custom", value="OTHER")
    .add("standardize_categories", column="segment", mapping={"building": "construction"})
    .add("clean_text", column="name", op="trim")
    .add("clean_numbers", column="balance_text", commas=True, currency=True, empty_as="invalid", on_invalid="null")
    .add("remove_rows_matching", rules=[{"column": "acctbal", "op": "lt", "value": "0"}])
    .add("remove_columns", names=["empty_col", "const_col", "seg_b"])
    .add("rename_column", old="seg_a", new="market")
)

_CUSTKEY = "c_custkey"
_TRIMMED = r"regexp_replace(trim(name), '\s+', ' ', 'g')"
_BALANCE = r"TRY_CAST(nullif(replace(regexp_replace(trim(balance_text), '[^\d.,\-]', '', 'g'), ',', ''), '') AS DOUBLE)"
_SEGMENT = f"""CASE WHEN {missing_sql('segment')} THEN 'OTHER' WHEN lower(trim(segment)) = 'building' THEN 'construction'
  ELSE segment END"""
_RECIPE_SQL = f"""SELECT c_custkey, {_TRIMMED} AS name, {_SEGMENT} AS segment,
  CASE WHEN NOT {missing_sql('balance_text')} THEN {_BALANCE} END AS balance_text, acctbal, email, active, seg_a AS market
  FROM messy_customer WHERE NOT {missing_sql('name')} AND NOT coalesce(acctbal < 0, FALSE)"""


@check("recipe_apply", "messy_customer", _RECIPE_SQL)
def _(df):
    return mr.Recipe.from_json(ROW_RECIPE.to_json()).apply(df)


@check(
    "recipe_undo",
    "messy_customer",
    f"""SELECT c_custkey, name, {_SEGMENT} AS segment, balance_text, acctbal, email, active, empty_col, const_col, seg_a, seg_b
    FROM messy_customer WHERE NOT {missing_sql('name')}""",
)
def _(df):
    shorter = ROW_RECIPE
    for _ in range(6):
        shorter = shorter.undo()
    return shorter.redo().apply(df)


_NAMED = f"NOT {missing_sql('name')}"
_MET = f"(SELECT count(*) FROM messy_customer WHERE {_NAMED})"
_LAST = f"(SELECT count(*) FROM messy_customer WHERE {_NAMED} AND NOT coalesce(acctbal < 0, FALSE))"
_STEPS = [
    ("remove_rows_with_missing", "(SELECT count(*) FROM messy_customer)", _MET, f"(SELECT count(*) FROM messy_customer WHERE NOT ({_NAMED}))"),
    ("fill_missing", _MET, _MET, f"(SELECT count(*) FROM messy_customer WHERE {_NAMED} AND {missing_sql('segment')})"),
    ("standardize_categories", _MET, _MET, f"(SELECT count(*) FROM messy_customer WHERE {_NAMED} AND NOT {missing_sql('segment')} AND lower(trim(segment)) = 'building')"),
    ("clean_text", _MET, _MET, "NULL"),
    ("clean_numbers", _MET, _MET, f"(SELECT count(*) FROM messy_customer WHERE {_NAMED} AND NOT {missing_sql('balance_text')} AND {_BALANCE} IS NULL)"),
    ("remove_rows_matching", _MET, _LAST, f"(SELECT count(*) FROM messy_customer WHERE {_NAMED} AND coalesce(acctbal < 0, FALSE))"),
    ("remove_columns", _LAST, _LAST, "NULL"),
    ("rename_column", _LAST, _LAST, "NULL"),
]


@check(
    "recipe_metrics",
    "messy_customer",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS step, '{op}' AS op, {b} AS rows_before, {a} AS rows_after, CAST({x} AS BIGINT) AS affected"
        for i, (op, b, a, x) in enumerate(_STEPS, 1)
    ),
)
def _(df):
    return ROW_RECIPE.metrics(df)


_WIDE = (
    mr.Recipe()
    .add("drop_duplicates", keys=["user_id", "event_type"], keep="last", order_by="event_id")
    .add("fill_missing", column="value", strategy="previous", order_by="event_id")
)


@check(
    "recipe_metrics_wide",
    "gappy_events",
    """, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r
      FROM gappy_events) WHERE r = 1),
    n AS (SELECT (SELECT count(*) FROM gappy_events) AS a, (SELECT count(*) FROM kept) AS b,
      (SELECT count(*) FROM kept WHERE value IS NULL AND event_id > (SELECT min(event_id) FROM kept WHERE value IS NOT NULL)) AS f)
    SELECT CAST(1 AS INTEGER) AS step, 'drop_duplicates' AS op, a AS rows_before, b AS rows_after, a - b AS affected FROM n
    UNION ALL SELECT 2, 'fill_missing', b, b, f FROM n""",
)
def _(df):
    return _WIDE.metrics(df)


def _recipe_apply_stream(spark, sf_dir):
    """The row recipe on a file stream of the customer table, read back from its Parquet sink."""
    schema = table(spark, sf_dir, "customer").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    stream.createOrReplaceTempView("customer")
    messy = spark.sql(VIEWS["messy_customer"][1])
    sink = scratch_path(spark, "stream")
    replay_stream(ROW_RECIPE, messy, f"{sink}/out", f"{sink}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{sink}/out")


QUERIES["recipe_apply_stream"] = _recipe_apply_stream
ORACLES["recipe_apply_stream"] = with_views(_RECIPE_SQL, "messy_customer")


@check(
    "recipe_join_dates",
    ("messy_orders", "messy_customer"),
    f"""SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, CAST(({date_sql('o.date_text')}) AS DATE) AS date_text, o.prio_status,
    m.name, m.segment FROM messy_orders o LEFT JOIN messy_customer m ON o.o_custkey = m.c_custkey
    WHERE NOT {missing_sql('o.date_text')}""",
)
def _(orders, customers):
    recipe = (
        mr.Recipe()
        .add("remove_rows_with_missing", columns=["date_text"])
        .add("convert_type", column="date_text", type="date", on_invalid="null")
        .add("join_tables", table="customers", keys=[["o_custkey", "c_custkey"]], how="left")
    )
    return recipe.apply(orders, {"customers": customers.select("c_custkey", "name", "segment")})

# --- files that are easy to read wrongly --------------------------------------------------------------------------


@check(
    "csv_roundtrip_events",
    "events",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value, value / 1e9 AS small, props FROM events""",
)
def _(df):
    """Times and doubles come back to the last digit."""
    path = scratch_path(df.sparkSession, "csv")
    mr.save_delimited(df.withColumn("small", F.col("value") / 1e9), path)
    back = mr.load_delimited(df.sparkSession, path, ",")
    return back.withColumns({c: F.col(c).cast(t) for c, t in (("ts", "timestamp_ntz"), ("value", "double"), ("small", "double"))})


#: Keys of a JSON array or document, and about as many of a Parquet file.
JSON_BLOCK, FILE_KEYS = 5_000, 100_000


@check("json_mixed_layouts", "customer", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(df):
    """A folder with JSON Lines, arrays and documents."""
    path = scratch_path(df.sparkSession, "json")
    rows = df.select("c_custkey", "c_name", "c_acctbal")
    part, block = F.col("c_custkey") % 3, F.floor(F.col("c_custkey") / JSON_BLOCK).alias("block")
    rows.filter(part == 0).write.mode("append").json(path)
    items = F.to_json(F.collect_list(F.struct(*rows.columns)))
    document = F.concat(F.lit('{\n"rows": '), items, F.lit("\n}"))
    # A file for each block, as an array or a document is written and read as a whole.
    for k, value in ((1, items), (2, document)):
        texts = rows.filter(part == k).groupBy(block).agg(value.alias("value")).select("value")
        texts.write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return mr.load_json(df.sparkSession, path)


@check("load_many_files", "orders", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders")
def _(df):
    """Row numbers follow the names of files, of which the later ones are the larger."""
    path = scratch_path(df.sparkSession, "parquet")
    last = df.agg(F.max("o_orderkey")).head()[0]
    edges = [0, last // 20, last // 4, last + 1]
    for k in range(3):
        some = df.filter(F.col("o_orderkey").between(edges[k] + (k > 0), edges[k + 1]))
        ranges = some.select("o_orderkey", "o_totalprice").repartitionByRange(2 + (edges[k + 1] - edges[k]) // FILE_KEYS, "o_orderkey")
        ranges.sortWithinPartitions("o_orderkey").write.parquet(f"{path}.parquet/part={k}")
    return mr.load(df.sparkSession, f"{path}.parquet", infer=False).drop("part")
