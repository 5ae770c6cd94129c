"""JSON records: arrays of objects, ``{"rows": [...]}`` documents and JSON Lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import RESCUED, Cell, col, data_columns
from millrace.operators.append import append
from millrace.sources.nested import split_objects
from millrace.sources.scratch import scratch_path

CORRUPT = "_corrupt_record"
MALFORMED = ("fail", "rescue")
HEAD_CHARS = 200
ROWS_HEAD = re.compile(r'\{\s*"rows"\s*:\s*\[')


def _layout_of(head: str) -> str:
    """``array``, ``lines`` (one whole object per line) or ``document`` (an object over several lines), by a first line."""
    if head.strip().startswith("["):
        return "array"
    try:
        json.loads(head)
        return "lines"
    except ValueError:
        return "lines" if head.strip().endswith("}") else "document"


def _layouts(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each layout, by their first characters; only of those that tell nothing, the first line is looked at."""
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    first = lambda sep: spark.read.options(**({"lineSep": sep} if sep else {})).text(path).select(F.col("_metadata.file_path").alias("file"), "value", at.alias("at"))
    begun = F.substring(F.regexp_replace("value", r"\A\s++", ""), 1, HEAD_CHARS)
    heads = first("}").filter(F.trim("value") != "").groupBy("file").agg(F.min_by(begun, "at").alias("head")).orderBy("file").collect()
    if not heads:
        raise ValueError(f"{path} is empty")
    out: dict[str, list[str]] = {}
    open_ = [r["file"] for r in heads if not r["head"].startswith("[") and not ROWS_HEAD.match(r["head"])]
    for r in heads:
        if r["file"] not in set(open_):
            out.setdefault("array" if r["head"].startswith("[") else "rows", []).append(r["file"])
    if open_:
        lines = first(None).filter(F.col("file").isin(open_) if len(heads) > len(open_) else F.lit(True)).filter(F.trim("value") != "")
        for r in lines.groupBy("file").agg(F.min_by("value", "at").alias("head")).orderBy("file").collect():
            out.setdefault(_layout_of(r["head"]), []).append(r["file"])
    return out


def _in_parts(spark: SparkSession, files: list[str], layout: str, malformed: str) -> list[DataFrame]:
    """Tables of arrays or documents: their objects, one a line, in order; files that hold more than those are read whole."""
    objects, odd = split_objects(spark, files, 1 if layout == "array" else 2)
    tables = []
    if len(odd) < len(files):
        lines = scratch_path(spark, "json-lines")
        objects = objects.where(~F.col("file").isin(odd)) if odd else objects
        objects.orderBy("file", "block", "n").select(F.translate("record", "\n\r", "  ").alias("value")).write.text(lines)
        tables.append(_load(spark, [lines], "lines", malformed, wrapped=False))
    if odd and layout == "array":
        tables.append(_load(spark, odd, "array", malformed))
    elif odd:
        heads = spark.read.text(odd).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
        kinds: dict[str, list[str]] = {}
        for r in heads.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "at").alias("head")).orderBy("file").collect():
            kinds.setdefault(_layout_of(r["head"]), []).append(r["file"])
        tables += [_load(spark, some, kind, malformed) for kind, some in kinds.items()]
    return tables


def record_keys(records: DataFrame, value: str, order: list[str]) -> list[str]:
    """Keys of JSON object texts in first-seen order. One key travels per task, not one per record."""
    keys = records.select(*order, F.posexplode(F.json_object_keys(value)).alias("_i", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(*order, "_i")).alias("at"))
    return [r["key"] for r in first.orderBy("at").collect()]


def load_json(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """Read JSON records; columns are the union of all keys in first-seen order, nested values become JSON text.

    JSON Lines files are read in splits; so are arrays and documents of a ``rows`` array alone, which are first taken apart into
    lines below ``spark.checkpoint.dir``. Documents with other keys besides, and files that are not made of objects
    throughout, are read by one task each. Files of different layouts may stand in one folder. A malformed record makes the query fail, or is kept as text under
    ``_record`` in the ``_rescued`` column (``malformed='rescue'``).
    """
    if malformed not in MALFORMED:
        raise ValueError(f"malformed is one of {MALFORMED}")
    tables: list[DataFrame] = []
    for layout, files in _layouts(spark, path).items():
        tables += _in_parts(spark, files, layout, malformed) if layout in ("array", "rows") else [_load(spark, files, layout, malformed)]
    return tables[0] if len(tables) == 1 else append(tables)


def _load(spark: SparkSession, files: list[str], layout: str, malformed: str, wrapped: bool | None = None) -> DataFrame:
    mode = "FAILFAST" if malformed == "fail" else "PERMISSIVE"
    table = spark.read.json(files, multiLine=layout != "lines", mode=mode, columnNameOfCorruptRecord=CORRUPT)
    if wrapped is None:
        wrapped = layout == "document" or (layout == "lines" and table.columns == ["rows"])
    if wrapped:
        inner = table.schema["rows"].dataType if "rows" in table.columns else None
        if not isinstance(inner, T.ArrayType) or not isinstance(inner.elementType, T.StructType):
            raise ValueError(f"{files[0]} holds neither an array of objects nor a rows array")
        table = table.select(F.inline("rows"))
    text = spark.read.text(files, wholetext=layout != "lines").withColumn("_file", F.monotonically_increasing_id())
    if layout == "lines" and not wrapped:
        records = text.withColumn("_n", F.lit(0))
    else:
        items = F.get_json_object("value", "$.rows") if wrapped else F.col("value")
        records = text.select("_file", F.posexplode(F.from_json(items, "array<string>")).alias("_n", "value"))
    order = [k for k in record_keys(records, "value", ["_file", "_n"]) if k in table.columns]
    if not order and CORRUPT not in table.columns:
        raise ValueError(f"{files[0]} holds no records")
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [F.to_json(col(c)).alias(c) if isinstance(table.schema[c].dataType, nested) else col(c) for c in order]
    if malformed == "rescue" and CORRUPT in table.columns and CORRUPT not in order:
        kept = F.when(col(CORRUPT).isNotNull(), F.create_map(F.lit("_record"), col(CORRUPT)))
        columns.append(F.coalesce(kept, F.create_map().cast("map<string,string>")).alias(RESCUED))
    return table.select(*columns)


def save_json(df: DataFrame, path: str, null_as_empty: bool = True, mode: str = "error") -> None:
    """Write one JSON object per row with every data column.

    With ``null_as_empty`` nulls are written as ``""``, which makes columns that hold nulls text columns.
    """
    columns = data_columns(df)
    if null_as_empty:
        df = df.select(*[F.coalesce(Cell(df, c).written, F.lit("")).alias(c) for c in columns])
    df.select(*[col(c) for c in columns]).write.mode(mode).json(path, ignoreNullFields=False)
