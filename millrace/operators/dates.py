"""Date clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import Cell, insert_after, replace_column

# The output formats and the date parts.
DATE_FORMATS = {"YYYY-MM-DD": "yyyy-MM-dd", "DD-MM-YYYY": "dd-MM-yyyy", "MM/DD/YYYY": "MM/dd/yyyy"}
DATE_PARTS = ("year", "month", "day", "weekday")


def standardize_dates(df: DataFrame, column: str, fmt: str = "YYYY-MM-DD") -> DataFrame:
    """Rewrite every parseable date in one format; other cells stay as they are."""
    cell = Cell(df, column)
    written = F.date_format(cell.date, DATE_FORMATS[fmt])
    return replace_column(df, column, F.when(cell.present, F.coalesce(written, cell.text)).otherwise(cell.text))


def not_a_date(df: DataFrame, column: str, **_) -> Column:
    """Present cells that do not parse as a date."""
    cell = Cell(df, column)
    return cell.present & cell.date.isNull()


def extract_date_part(df: DataFrame, column: str, part: str) -> DataFrame:
    """Add ``<column>_<part>`` right after the source: year, month, day (integers) or English weekday name."""
    date = Cell(df, column).date
    value = {
        "year": lambda: F.year(date),
        "month": lambda: F.month(date),
        "day": lambda: F.dayofmonth(date),
        "weekday": lambda: F.date_format(date, "EEEE"),
    }[part]()
    return insert_after(df, column, [(f"{column}_{part}", value)])
