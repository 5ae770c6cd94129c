"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import Cell, col, data_columns, fresh
from millrace.functions.predicates import predicate


def filter_rows(df: DataFrame, rules: Iterable, combinator: str = "AND") -> DataFrame:
    """Keep the rows that satisfy the rules."""
    return df.filter(predicate(df, rules, combinator))


def not_matching(df: DataFrame, rules: Iterable, combinator: str = "AND") -> Column:
    rules = list(rules)
    if not rules:
        raise ValueError("remove_rows_matching needs at least one rule")
    return ~predicate(df, rules, combinator)


def remove_rows_matching(df: DataFrame, rules: Iterable, combinator: str = "AND") -> DataFrame:
    """Drop the rows that satisfy the rules. An empty rule list would drop everything, so it is refused."""
    return df.filter(not_matching(df, rules, combinator))


def not_empty(df: DataFrame) -> Column:
    columns = data_columns(df)
    return reduce(lambda a, b: a | b, [Cell(df, c).present for c in columns]) if columns else F.lit(True)


def remove_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is missing."""
    return df.filter(not_empty(df)) if data_columns(df) else df


def without_missing(df: DataFrame, columns: list[str] | None = None) -> Column:
    columns = columns or data_columns(df)
    return reduce(lambda a, b: a & b, [Cell(df, c).present for c in columns], F.lit(True))


def remove_rows_with_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows in which any of the columns (default: all) is missing."""
    return df.filter(without_missing(df, columns))


def _listed(df: DataFrame, keys: DataFrame | Iterable, key: str | list[str]) -> tuple[DataFrame, list[Column]]:
    """The distinct listed keys under private names, and how a row matches them."""
    names = [key] if isinstance(key, str) else list(key)
    if not isinstance(keys, DataFrame):
        schema = df.select(*[col(n) for n in names]).schema
        rows = [k if isinstance(k, (tuple, list)) else (k,) for k in keys]
        keys = df.sparkSession.createDataFrame(rows, schema)
    private = fresh(df, *[f"_k{i}" for i in range(len(names))])
    listed = keys.select(*[col(n).alias(k) for n, k in zip(names, private)]).distinct()
    return listed, [col(n) == F.col(k) for n, k in zip(names, private)]


def remove_rows_by_key(df: DataFrame, keys: DataFrame | Iterable, key: str | list[str]) -> DataFrame:
    """Drop the rows whose key is listed, either as a DataFrame holding the key columns or as plain values.

    The listed keys are made distinct first, so the anti join never meets a repeated key on that side; Spark broadcasts
    it when its measured size is below the session's threshold and splits hot keys of ``df`` otherwise.
    """
    return df.join(*_listed(df, keys, key), "left_anti")


def mark_rows_by_key(df: DataFrame, mark: str, keys: DataFrame | Iterable, key: str | list[str]) -> DataFrame:
    """Every row, with whether its key is listed in the column ``mark``."""
    listed, match = _listed(df, keys, key)
    marked = df.join(listed.withColumn(mark, F.lit(True)), match, "left")
    return marked.select(*[col(c) for c in df.columns], F.coalesce(F.col(mark), F.lit(False)).alias(mark))


def containing(df: DataFrame, text: str, columns: list[str] | None = None) -> Column:
    needle = text.strip().lower()
    if not needle:
        return F.lit(True)
    columns = columns or data_columns(df)
    hits = [F.lower(F.coalesce(Cell(df, c).text, F.lit(""))).contains(F.lit(needle)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def search_rows(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any visible column contains the text, ignoring letter case. Blank text keeps every row."""
    return df.filter(containing(df, text, columns)) if text.strip() else df
