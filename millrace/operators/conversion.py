"""How a conversion treats the cells it cannot convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import RESCUED, Cell, col, replace_column, to_str

ON_INVALID = ("rescue", "null", "keep")


def apply_conversion(df: DataFrame, cell: Cell, value: Column, dtype, failed: Column, on_invalid: str) -> DataFrame:
    """Replace the cell's column by ``value`` (of type ``dtype``, null where missing or failed).

    ``rescue`` keeps the text of failed cells in the map column ``_rescued`` under the column's name, ``null`` drops
    it, and ``keep`` gives a text column holding converted text where possible and the raw text elsewhere.
    """
    if on_invalid not in ON_INVALID:
        raise ValueError(f"on_invalid is one of {ON_INVALID}")
    if on_invalid == "keep":
        return replace_column(df, cell.name, F.when(failed, cell.text).otherwise(to_str(value, dtype)))
    if on_invalid == "rescue":
        empty = F.create_map().cast("map<string,string>")
        if RESCUED in df.columns:
            others = F.map_filter(F.coalesce(col(RESCUED), empty), lambda k, _: k != F.lit(cell.name))
        else:
            others = empty
        kept = F.when(failed, F.map_concat(others, F.create_map(F.lit(cell.name), cell.text))).otherwise(others)
        df = df.withColumn(RESCUED, kept)
    return replace_column(df, cell.name, value)
