"""Load any supported file by its extension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.functions.cells import ROW_ID, col, fresh
from millrace.operators.types import with_inferred_types
from millrace.sources.delimited import load_delimited
from millrace.sources.records import load_json
from millrace.sources.scratch import scratch_path
from millrace.sources.workbooks import load_workbooks

# What the file extensions stand for.
DELIMITED = {"csv": ",", "tsv": "\t", "txt": None}
TYPED = ("parquet", "orc")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The bare table of a file or folder, chosen by extension."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension in DELIMITED:
        return load_delimited(spark, path, DELIMITED[extension])
    if extension in ("json", "jsonl"):
        return load_json(spark, path)
    if extension == "xlsx":
        return load_workbooks(spark, path)
    if extension in TYPED:
        return spark.read.format(extension).load(path)
    raise ValueError(f"unsupported file type .{extension}: use csv, tsv, txt, json, xlsx, parquet or orc")


def _with_row_ids(df: DataFrame) -> DataFrame:
    """Number rows by file path, place of the split in its file, and place in the split.

    A scan packs splits by size and numbers them as it meets them, so the numbers are put in order afterwards: the table
    is written once to the session's shared folder together with where each row is from, and every split's first number
    follows from the counts of those before it.
    """
    spark = df.sparkSession
    if ROW_ID in df.columns:
        raise ValueError(f"the source has a column {ROW_ID} of its own: load it with row_ids=False")
    file, block, met = fresh(df, "_file", "_block", "_met")
    place = {file: F.col("_metadata.file_path"), block: F.col("_metadata.file_block_start")}
    try:
        placed = df.select("*", *[c.alias(n) for n, c in place.items()], F.monotonically_increasing_id().alias(met))
        placed.schema  # noqa: B018  tables that are no plain file scan have no such metadata
    except AnalysisException:
        placed = df.select("*", F.lit("").alias(file), F.lit(0).alias(block), F.monotonically_increasing_id().alias(met))
    copy = scratch_path(spark, "load")
    placed.write.parquet(copy)
    stored = spark.read.schema(placed.schema).parquet(copy)
    if isinstance(placed.select(block).schema[0].dataType, IntegerType):
        return stored.withColumnRenamed(met, ROW_ID).drop(file, block)
    size, start, offset = fresh(placed, "_size", "_start", "_offset")
    splits = stored.groupBy(file, block).agg(F.count("*").alias(size), F.min(met).alias(start))
    earlier = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)  # one row per split of the scan
    offsets = splits.select(file, block, start, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(offset))
    numbered = stored.join(offsets, [file, block])
    row_id = F.col(offset) + F.col(met) - F.col(start)
    return numbered.select(*[col(c).alias(c, metadata=df.schema[c].metadata) for c in df.columns], row_id.alias(ROW_ID))


def load(spark: SparkSession, path: str, infer: bool = True, row_ids: bool = True) -> DataFrame:
    """Read a file or folder, number its rows in ``_row_id`` and label the columns with inferred types.

    Numbers follow the order of file paths, and in a file the order of its rows. All later steps, re-run tasks included,
    see the same numbers. Tables with a key of their own do not need the copy this takes (``row_ids=False``).
    """
    df = read_any(spark, path)
    if row_ids:
        df = _with_row_ids(df)
    return with_inferred_types(df, cells="typed") if infer else df
