"""One row per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import Cell, is_floating, is_missing, is_numeric, to_str

VALUE, NUM, IS_TEXT = "value", "num", "is_text"


def cells_long(df: DataFrame, names: list[str], extra: list[Column] | None = None) -> DataFrame:
    """``column``, ``is_text``, ``value`` (display text, null when missing) and ``num`` (of number columns).

    Only the display text is taken per column; the costlier rules run once, on the single ``value`` column behind the
    unpivot, so generated code does not grow with the number of columns.
    """
    cells = []
    for name in names:
        cell = Cell(df, name)
        number = cell.raw.cast("double") if is_numeric(cell.dtype) else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(cell.is_text).alias(IS_TEXT),
                (F.lit(None).cast("string") if isinstance(cell.dtype, T.DoubleType) else cell.text).alias(VALUE),
                (F.when(cell.present, number) if is_floating(cell.dtype) else number).alias(NUM),
            )
        )
    long = df.select(*(extra or []), F.inline(F.array(*cells)))
    present = ~F.col(IS_TEXT) | ~is_missing(F.col(VALUE), T.StringType())
    finite = F.abs(F.col(NUM)) < F.lit(float("inf"))
    return long.withColumns(
        {
            VALUE: F.when(present, F.coalesce(F.col(VALUE), to_str(F.col(NUM), T.DoubleType()))),
            NUM: F.when(finite, F.col(NUM)),
        }
    )
