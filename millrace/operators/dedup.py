"""Duplicate rows.

Both operators are grouped aggregations. Partial aggregation collapses a key inside each map task before anything is
shuffled, so a key shared by a large part of the table reaches its reducer as one record per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import Cell, col, data_columns, fingerprint, is_floating, is_numeric
from millrace.plans.buckets import as_keys, position


def _as_list(order_by: str | list[str] | None) -> list[str]:
    if not order_by:
        return []
    return [order_by] if isinstance(order_by, str) else list(order_by)


def count_duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A one-row table: ``duplicates`` is the number of rows beyond the first of each key.

    Null equals null and NaN equals null. Keys are grouped by a 128-bit fingerprint, so no row is shuffled whole.
    """
    keys = keys or data_columns(df)
    if not keys:
        return df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("duplicates"))
    one, two = fingerprint([Cell(df, k).identity for k in keys])
    groups = df.select(one.alias("one"), two.alias("two")).groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def drop_duplicates(
    df: DataFrame,
    keys: list[str] | None = None,
    keep: str = "first",
    order_by: str | list[str] | None = None,
) -> DataFrame:
    """Keep the first or last row of each key in ``order_by`` order.

    ``keys`` defaults to every column except those that give the order. ``keep='any'`` needs no order.
    """
    order = _as_list(order_by)
    if keep == "any":
        return df.dropDuplicates(keys or data_columns(df))
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first', 'last' or 'any'")
    if not order:
        raise ValueError("keep='first' and keep='last' need order_by: rows of a DataFrame have no order of their own")
    return first_of_each(df, keys or [c for c in data_columns(df) if c not in order], keep, order)


def first_of_each(
    df: DataFrame, keys: list[str], keep: str, order: list[str], apart: Column | None = None, summed: tuple[str, ...] = ()
) -> DataFrame:
    """The first or last row of each key. Rows with another value of ``apart`` are another key's; a column in ``summed`` becomes
    its sum over the key's rows instead of the kept row's own value."""
    pick = F.min_by if keep == "first" else F.max_by
    place = position(df, as_keys(df, order))
    carried = [c for c in df.columns if c not in keys and c not in summed]
    fixed = len(order) == 1 and all(_fixed_width(df.schema[c].dataType) for c in carried)
    source, aggregates = {}, []
    for i, c in enumerate(summed):
        aggregates.append(F.sum(c).alias(f"_sum{i}"))
        source[c] = F.col(f"_sum{i}")
    for i, k in enumerate(keys):
        source[k] = F.col(f"_key{i}")
        if is_floating(df.schema[k].dataType):  # null and NaN share a group; the kept row says which one it had
            aggregates.append(pick(F.isnan(col(k)), place).alias(f"_nan{i}"))
            source[k] = F.when(F.col(f"_nan{i}"), F.lit(float("nan"))).otherwise(F.col(f"_key{i}"))
    if fixed:  # numbers, dates and flags only: Spark hashes such states instead of sorting rows
        for i, c in enumerate(carried):
            aggregates.append(pick(col(c), place).alias(f"_carried{i}"))
            source[c] = F.col(f"_carried{i}")
    elif carried:
        aggregates.append(pick(F.struct(*[col(c) for c in carried]), place).alias("_row"))
        source |= {c: F.col("_row").getField(c) for c in carried}
    groups = [Cell(df, k).identity.alias(f"_key{i}") for i, k in enumerate(keys)]
    grouped = df.groupBy(*groups, *([] if apart is None else [apart.alias("_apart")]))
    chosen = grouped.agg(*aggregates) if aggregates else grouped.agg(F.count(F.lit(1)))
    return chosen.select(*[source[c].alias(c, metadata=df.schema[c].metadata) for c in df.columns])


def _fixed_width(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or isinstance(dtype, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
