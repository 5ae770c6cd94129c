"""Outlier bounds, flagged rows and their removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import Cell
from millrace.plans.order_stats import order_statistics

# The fences of the two methods.
IQR_FACTOR = 1.5
Z_LIMIT = 3.0


@dataclass(frozen=True)
class Outliers:
    """The flagged rows of a table and the bounds that flagged them."""

    low: float
    high: float
    rows: DataFrame


def _number(cell: Cell, nulls_as_zero: bool) -> Column:
    return F.when(cell.raw.isNull(), F.lit(0.0)).otherwise(cell.num) if nulls_as_zero else F.when(cell.present, cell.num)


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", nulls_as_zero: bool = False) -> tuple:
    """``(low, high, flagged)`` where ``flagged`` is a boolean expression over ``df``.

    ``iqr`` uses the exact values at ranks ``floor(n/4)`` and ``floor(3n/4)`` without interpolation, ``zscore`` the
    population standard deviation. The bounds are two numbers, so the filter they form is a plain scan.
    """
    number = _number(Cell(df, column), nulls_as_zero)
    if method == "iqr":
        values = df.select(number.alias("x"))
        n, quartiles = order_statistics(values, lambda n: [int(n * 0.25), int(n * 0.75)])
        if n == 0:
            return 0.0, 0.0, F.lit(False)
        q1, q3 = quartiles
        low, high = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
        return low, high, F.coalesce((number < low) | (number > high), F.lit(False))
    if method == "zscore":
        mean, std = df.agg(F.avg(number), F.stddev_pop(number)).head()
        if mean is None:
            return 0.0, 0.0, F.lit(False)
        std = std or 1.0
        flagged = F.coalesce(F.abs((number - mean) / std) > Z_LIMIT, F.lit(False))
        return mean - Z_LIMIT * std, mean + Z_LIMIT * std, flagged
    raise ValueError("method is 'iqr' or 'zscore'")


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", nulls_as_zero: bool = False) -> Outliers:
    """Rows whose number lies outside the bounds. Missing and non-numeric cells are never flagged."""
    low, high, flagged = outlier_bounds(df, column, method, nulls_as_zero)
    return Outliers(low, high, df.filter(flagged))


def within_bounds(df: DataFrame, column: str, method: str = "iqr", nulls_as_zero: bool = False) -> Column:
    *_, flagged = outlier_bounds(df, column, method, nulls_as_zero)
    return ~flagged


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", nulls_as_zero: bool = False) -> DataFrame:
    """Drop exactly the rows ``detect_outliers`` flags."""
    return df.filter(within_bounds(df, column, method, nulls_as_zero))
