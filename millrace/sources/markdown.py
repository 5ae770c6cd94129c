"""Markdown tables and the cleaning report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import Cell, data_columns
from millrace.operators.types import logical_type
from millrace.plans.buckets import as_keys

REPORT_ROWS = 10


def markdown_header(df: DataFrame) -> list[str]:
    """Header and divider line; number columns align right."""
    columns = data_columns(df)
    marks = ["---:" if logical_type(df, c) in ("integer", "decimal") else "---" for c in columns]
    return ["| " + " | ".join(c.replace("|", r"\|") for c in columns) + " |", "|" + "|".join(marks) + "|"]


def markdown_rows(df: DataFrame) -> DataFrame:
    """Each row as one ``| a | b |`` line in column ``line``; pipes inside cells are escaped, nulls are empty."""
    cells = [F.replace(F.coalesce(Cell(df, c).written, F.lit("")), F.lit("|"), F.lit(r"\|")) for c in data_columns(df)]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def save_markdown(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write the table as text files; the first one holds the header lines."""
    header = df.sparkSession.createDataFrame([("\n".join(markdown_header(df)),)], "line string").coalesce(1)
    header.union(markdown_rows(df)).write.mode(mode).text(path)


def report_counts(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row with the row and column counts before and after."""
    count = F.count(F.lit(1))
    before, after = original.agg(count).scalar(), cleaned.agg(count).scalar()
    return original.sparkSession.range(1).select(
        before.alias("original_rows"),
        F.lit(len(data_columns(original))).cast("bigint").alias("original_columns"),
        after.alias("rows"),
        F.lit(len(data_columns(cleaned))).cast("bigint").alias("columns"),
    )


def cleaning_report(original: DataFrame, cleaned: DataFrame, labels: list[str], order_by: str | list[str]) -> str:
    """A Markdown report: sizes before and after, the steps, and the first rows of the result."""
    counts = report_counts(original, cleaned).head()
    first = cleaned.orderBy(*[k.ordered() for k in as_keys(cleaned, order_by)]).limit(REPORT_ROWS)
    steps = [f"- {label}" for label in labels] or ["- No cleaning steps applied"]
    sections = {
        "# Data Cleaning Report": [],
        "## Dataset": [f"- Original rows: {counts[0]}", f"- Original columns: {counts[1]}"],
        "## Cleaning performed": steps,
        "## Final dataset": [f"- Rows: {counts[2]}", f"- Columns: {counts[3]}"],
        "## Preview": [*markdown_header(cleaned), *[r["line"] for r in markdown_rows(first).collect()]],
    }
    return "\n\n".join("\n".join(part) for title, body in sections.items() for part in ([title], body) if part) + "\n"
