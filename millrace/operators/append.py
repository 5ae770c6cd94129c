"""Stacking tables by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import Cell, col, is_numeric, name_folder


def _column_order(tables: list[DataFrame]) -> list[str]:
    return list(dict.fromkeys(c for t in tables for c in t.columns))


def append(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns in first-seen order, null where a table lacks one.

    Numeric types widen; a column held in otherwise different types becomes text. The label of a column is that of
    the first table that has it. The union is one narrow step without a shuffle.
    """
    if not tables:
        raise ValueError("append needs at least one table")
    order, aligned, fold = _column_order(tables), [], name_folder(tables[0])
    clash = [c for c in order if [fold(o) for o in order].count(fold(c)) > 1]
    if clash:
        raise ValueError(f"column names differ in letter case only: {clash}")
    as_text = set()
    for c in order:
        types = {t.schema[c].dataType for t in tables if c in t.columns}
        if len(types) > 1 and not all(is_numeric(x) for x in types):
            as_text.add(c)
    for t in tables:
        aligned.append(t.select(*[Cell(t, c).text.alias(c) if c in as_text else col(c) for c in t.columns]))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    first = {c: next(t for t in tables if c in t.columns).schema[c].metadata for c in order}
    return union.select(*[col(c).alias(c, metadata=first[c]) for c in order])


def append_preview(tables: list[DataFrame]) -> DataFrame:
    """One row: shared columns, columns others lack, columns the first lacks, and the resulting row count."""
    if not tables:
        raise ValueError("append_preview needs at least one table")
    order, first, rest = _column_order(tables), tables[0].columns, tables[1:]
    common = [c for c in order if all(c in t.columns for t in tables)]
    only_first = [c for c in first if not all(c in t.columns for t in rest)]
    only_rest = [c for c in _column_order(rest) if c not in first]
    counts = reduce(lambda a, b: a.unionByName(b), [t.agg(F.count(F.lit(1)).alias("n")) for t in tables])

    def names(values: list[str]):
        return F.lit(values) if values else F.array().cast("array<string>")

    return counts.agg(F.sum("n").alias("total_rows")).select(
        names(common).alias("common_columns"),
        names(only_first).alias("only_in_first"),
        names(only_rest).alias("only_in_rest"),
        "total_rows",
    )
