"""Sorting and paging. Missing cells sort last in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import Cell, fresh, is_string
from millrace.plans.buckets import SortKey, as_keys, with_position

# Text compares by language rules, without letter case and accents (sorting) or with them (grid view).
FOLDED = "UNICODE_CI_AI"
EXACT = "UNICODE"

DEEP_PAGE_ROWS = 100_000


def natural_text(text: Column) -> Column:
    """Text in which every digit run carries its length in front, so that ``item2`` sorts before ``item10``."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))

    def weighted(run: Column) -> Column:
        digits = F.regexp_replace(run, r"\A0+(?=\d)", "")
        return F.when(run.rlike(r"\A\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, weighted), "")


def sort_keys(df: DataFrame, keys: list, collation: str = FOLDED) -> list[SortKey]:
    """Sort keys for ``(column, 'asc'|'desc')`` pairs: missing last, numbers by value, text in natural order."""
    out = []
    for key in keys:
        name, direction = (key, "asc") if isinstance(key, str) else key
        if direction not in ("asc", "desc"):
            raise ValueError("a sort direction is 'asc' or 'desc'")
        cell, ascending = Cell(df, name), direction == "asc"
        out.append(SortKey(cell.missing))
        if is_string(cell.dtype):
            out.append(SortKey(F.when(cell.present, natural_text(cell.text)), ascending, collation))
        else:
            out.append(SortKey(F.when(cell.present, cell.raw), ascending))
    return out


def sort_rows(df: DataFrame, keys: list, order_by: str | list[str] | None = None) -> DataFrame:
    """Sort by several keys; rows that tie keep their ``order_by`` order. No keys change nothing.

    A global sort is range-partitioned by Spark, so it spreads over the cluster.
    """
    if not keys:
        return df
    ties = as_keys(df, order_by) if order_by else []
    return df.orderBy(*[k.ordered() for k in [*sort_keys(df, keys), *ties]])


def number_rows(
    df: DataFrame,
    keys: list,
    order_by: str | list[str],
    name: str = "pos",
    buckets: int | None = None,
    collation: str = FOLDED,
) -> DataFrame:
    """Add each row's 1-based position in sorted order (the row order a DataFrame itself does not keep)."""
    return with_position(df, [*sort_keys(df, keys, collation), *as_keys(df, order_by)], name, buckets)


def page(df: DataFrame, keys: list, order_by: str | list[str], n: int = 0, size: int = 50) -> DataFrame:
    """Page ``n`` (from 0) of the table in grid order; text compares with letter case and accents here.

    Front pages are a top-k, which Spark merges on the driver; pages deeper than ``DEEP_PAGE_ROWS`` are cut out by
    position instead.
    """
    if (n + 1) * size > DEEP_PAGE_ROWS:
        (pos,) = fresh(df, "_pos")
        numbered = number_rows(df, keys, order_by, pos, collation=EXACT)
        chosen = numbered.filter(F.col(pos).between(n * size + 1, (n + 1) * size))
        return chosen.orderBy(pos).drop(pos)
    ordered = df.orderBy(*[k.ordered() for k in [*sort_keys(df, keys, EXACT), *as_keys(df, order_by)]])
    return ordered.offset(n * size).limit(size)
