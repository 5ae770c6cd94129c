"""Delimited text: CSV, TSV and text with a detected delimiter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.cells import Cell, data_columns
from millrace.sources.quoted import split_records

# The delimiters that are recognised, most common first.
DELIMITERS = (",", "\t", "|", ";")
SNIFF_LINES = 10

_FORMAT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter most of the first lines hold as often as the header does; lines with fewer count half."""
    lines = [r[0] for r in spark.read.text(path).filter(F.trim("value") != "").limit(SNIFF_LINES).collect()]
    best, most = DELIMITERS[0], (0.0, 0)
    for d in DELIMITERS:
        counts = ["".join(line.split('"')[::2]).count(d) for line in lines]  # delimiters outside quotes
        header = counts[0] if counts else 0
        score = sum(1.0 if n == header else 0.5 if 0 < n < header else 0.0 for n in counts)
        if header and (score, header) > most:
            best, most = d, (score, header)
    return best


def multiline_files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """The files in which a quoted cell may run over a line end, and whether a bare carriage return may be such an end."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    bare = F.instr(F.regexp_replace("value", r"\r\z", ""), "\r") > 0
    found = lines.groupBy("file").agg(F.max(quotes % 2 == 1).alias("odd"), F.max(bare).alias("bare"), F.max(quotes > 0).alias("quoted"))
    found = found.where("odd OR (bare AND quoted)").orderBy("file")
    return [(r["file"], r["bare"]) for r in found.collect()]


def _from_splits(spark: SparkSession, files: list[str], sep: str, schema: StructType, same_header: bool) -> DataFrame:
    """Rows of files with cells over several lines, by as many tasks as the files have splits, in order."""
    texts = ", ".join(f"c{k} string" for k in range(len(schema)))
    options = {**{k: str(v) for k, v in _FORMAT.items() if k != "header"}, "sep": sep, "multiLine": "true", "mode": "PERMISSIVE"}
    records = split_records(spark, files, sep).withColumn("cells", F.from_csv("record", texts, options))
    is_header = (F.col("block") == 0) & (F.col("n") == 0)
    if same_header:
        heads = [tuple((x or "").removeprefix("\ufeff") for x in r[0]) for r in records.where(is_header).select("cells").distinct().limit(2).collect()]
        wanted = tuple(n.removeprefix("\ufeff") for n in schema.names)
        if any(h != wanted for h in heads):
            raise ValueError(f"headers differ: {heads} and {list(wanted)}")
    cells = records.where(~is_header).orderBy("file", "block", "n").select("cells.*")
    return cells.toDF(*schema.names)


def _may_be_renamed(names: list[str]) -> bool:
    """Whether the reader may have given columns other names than the header: empty and repeated ones get a number."""
    stems = [n[: -len(str(i))] for i, n in enumerate(names) if n.endswith(str(i))]
    return any(s in ("_c", "") for s in stems) or len(set(stems)) < len(stems)


def load_delimited(spark: SparkSession, path: str, sep: str | None = None, multiline: bool | None = None) -> DataFrame:
    """Read delimited text with a header row; every cell stays text and an empty cell is null.

    Short lines are padded with nulls, surplus fields and blank lines are dropped. Files of a folder must have the same
    header: others make the query fail. ``multiline=None`` takes a pass over the text to see which files hold cells
    that run over a line end; they are read in splits like all others, with a pass more that tells how each split begins.
    Only where a bare carriage return may end a line, a file with such cells is read by one task; so are all files with
    ``multiline=True``.
    """
    sep = sniff_delimiter(spark, path) if sep is None else sep
    base = spark.read.options(**_FORMAT, mode="PERMISSIVE")
    long = multiline_files(spark, path) if multiline is None else []
    df = base.options(multiLine=bool(multiline) or bool(long)).csv(path, sep=sep)
    if not df.columns:
        raise ValueError(f"{path} has no header row")
    same_header = not _may_be_renamed(df.columns)
    if same_header:
        base = base.options(enforceSchema=False)
    schema = df.schema
    if long:
        files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"))
        short = [r[0] for r in files.distinct().collect() if r[0] not in {f for f, _ in long}]
        split, bare = ([f for f, b in long if b == kind] for kind in (False, True))
        parts = [_from_splits(spark, split, sep, schema, same_header)] if split else []
        parts += [base.options(multiLine=kind).schema(schema).csv(some, sep=sep) for kind, some in ((True, bare), (False, short)) if some]
        df = reduce(DataFrame.union, parts)
    else:
        df = base.options(multiLine=bool(multiline)).schema(schema).csv(path, sep=sep)
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])


def save_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """Write the data columns in order with a header row; null becomes an empty field."""
    text = df.select(*[Cell(df, c).written.alias(c) for c in data_columns(df)])
    text.write.mode(mode).options(**_FORMAT, nullValue="", emptyValue="").csv(path, sep=sep)
