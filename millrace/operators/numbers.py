"""Number clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import Cell, bind, text_to_num, ws_trim
from millrace.operators.conversion import apply_conversion

# Fixed value: what stays when currency symbols are removed.
CURRENCY_NOISE = r"[^\d.,\-]"


def clean_numbers(
    df: DataFrame,
    column: str,
    commas: bool = False,
    currency: bool = False,
    percent: bool = False,
    round: int | None = None,
    empty_as: str = "zero",
    on_invalid: str = "rescue",
) -> DataFrame:
    """Strip currency symbols, thousands commas and percent signs, then read the cell as a number.

    A present cell of which nothing is left reads as 0 (``empty_as='zero'``) or fails (``'invalid'``). Percentages are
    not divided by 100. ``round`` rounds half away from zero.
    """
    cell = Cell(df, column)
    bound, (text,) = bind(df, _stripped(cell, commas, currency, percent))
    number = _number(F.col(text), empty_as)
    if round is not None:
        number = F.round(number, round)
    bound, (value,) = bind(bound, F.when(cell.present, number))
    failed = cell.present & F.col(value).isNull()
    return apply_conversion(bound, cell, F.col(value), T.DoubleType(), failed, on_invalid).drop(text, value)


def not_a_number(
    df: DataFrame,
    column: str,
    commas: bool = False,
    currency: bool = False,
    percent: bool = False,
    empty_as: str = "zero",
    **_,
) -> Column:
    """Present cells that ``clean_numbers`` with the same options cannot read."""
    cell = Cell(df, column)
    return cell.present & _number(_stripped(cell, commas, currency, percent), empty_as).isNull()


def _stripped(cell: Cell, commas: bool, currency: bool, percent: bool) -> Column:
    text = ws_trim(cell.text)
    if currency:
        text = F.regexp_replace(text, CURRENCY_NOISE, "")
    if commas:
        text = F.replace(text, F.lit(","), F.lit(""))
    if percent:
        text = F.replace(text, F.lit("%"), F.lit(""))
    return text


def _number(text: Column, empty_as: str) -> Column:
    number = text_to_num(text)
    return F.when(ws_trim(text) == "", F.lit(0.0)).otherwise(number) if empty_as == "zero" else number
