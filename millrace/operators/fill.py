"""Filling missing cells."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cells import (
    MISSING_TOKENS,
    Cell,
    col,
    fresh,
    is_integral,
    is_string,
    replace_column,
    to_str,
)
from millrace.plans.buckets import SortKey, as_keys, position, range_bucket
from millrace.plans.order_stats import order_statistics

# The ways to fill.
STRATEGIES = ("mean", "median", "mode", "zero", "custom", "previous", "next")


def count_missing(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """A one-row table with the number of missing cells of each column under the column's name."""
    names = [columns] if isinstance(columns, str) else columns
    return df.agg(*[F.count_if(Cell(df, c).missing).alias(c) for c in names])


def fill_missing(
    df: DataFrame,
    column: str,
    strategy: str,
    value=None,
    order_by: str | list[str] | None = None,
    partition_by: list[str] | None = None,
    approx: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Fill the missing cells of a column.

    ``mean``, ``median`` and ``mode`` derive the value from the present cells, ``zero`` and ``custom`` use a constant,
    ``previous`` and ``next`` carry the nearest present cell along ``order_by`` (within ``partition_by`` groups if
    given). Integer columns become decimal under ``mean`` and ``median``. ``approx`` uses a median sketch.
    """
    cell = Cell(df, column)
    if strategy in ("previous", "next"):
        return _carry(df, cell, strategy, order_by, partition_by or [], buckets)
    if strategy == "zero":
        return _fill(df, cell, _constant(cell, 0))
    if strategy == "custom":
        return _fill(df, cell, _constant(cell, "" if value is None else value))
    if strategy in ("mean", "median"):
        return _fill_number(df, cell, _mean(df, cell) if strategy == "mean" else _median(df, cell, approx))
    if strategy == "mode":
        return _fill(df, cell, _mode(df, cell, order_by).try_cast(cell.dtype))
    raise ValueError(f"strategy is one of {STRATEGIES}")


def _fill(df: DataFrame, cell: Cell, value: Column) -> DataFrame:
    return replace_column(df, cell.name, F.when(cell.missing, value).otherwise(cell.raw))


def _constant(cell: Cell, value) -> Column:
    if is_string(cell.dtype):
        text = str(value)
        if text.strip().lower() in MISSING_TOKENS:
            warnings.warn(f"the fill value {text!r} itself counts as a missing cell", stacklevel=3)
        return F.lit(text)
    try:
        if isinstance(cell.dtype, (T.DoubleType, T.FloatType)):
            value = float(value)
        elif is_integral(cell.dtype):
            value = int(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{value!r} does not fit column {cell.name!r} of type {cell.dtype.simpleString()}") from e
    return F.lit(value).try_cast(cell.dtype)


def _fill_number(df: DataFrame, cell: Cell, value: Column) -> DataFrame:
    if is_string(cell.dtype):
        return _fill(df, cell, to_str(value, T.DoubleType()))
    if isinstance(cell.dtype, (T.FloatType, T.DecimalType)) or is_integral(cell.dtype):
        return replace_column(df, cell.name, F.when(cell.missing, value).otherwise(cell.raw.cast("double")))
    return _fill(df, cell, value)


def _mean(df: DataFrame, cell: Cell) -> Column:
    return df.agg(F.avg(F.when(cell.present, cell.num))).scalar()


def _median(df: DataFrame, cell: Cell, approx: bool) -> Column:
    values = df.select(F.when(cell.present, cell.num).alias("x"))
    if approx:
        return values.agg(F.percentile_approx("x", 0.5)).scalar()
    n, middle = order_statistics(values, lambda n: [(n - 1) // 2, n // 2])
    return F.lit((middle[0] + middle[1]) / 2 if n % 2 == 0 else middle[0]) if n else F.lit(None).cast("double")


def _mode(df: DataFrame, cell: Cell, order_by) -> Column:
    """Most frequent text; of equally frequent ones the one met first. Counts combine before the shuffle."""
    first = F.min(position(df, as_keys(df, order_by)))
    counts = df.filter(cell.present).groupBy(cell.text.alias("v")).agg(F.count(F.lit(1)).alias("n"), first.alias("at"))
    return counts.orderBy(F.col("n").desc(), F.col("at")).limit(1).select("v").scalar()


def _carry(
    df: DataFrame, cell: Cell, strategy: str, order_by, partition_by: list[str], buckets: int | None
) -> DataFrame:
    """Carry the nearest present cell along the order, range by range.

    Windows run per range of the order (see :mod:`millrace.plans.buckets`), so neither the whole table nor one large
    group is ever sorted in a single task. What a range inherits from the ranges before it comes from a second, small
    table with one row per group and range. Without groups that table has at most ``MAX_BUCKETS`` rows and is
    broadcast; with groups it is joined on group and range, the partitioning the window needs anyway.
    """
    forward = strategy == "previous"
    keys = as_keys(df, order_by)
    bucket, edge, their_bucket, inherited_name, *named = fresh(
        df, "_bucket", "_edge", "_rbucket", "_inherited", *[f"_g{i}" for i in range(2 * len(partition_by))]
    )
    groups, their_groups = named[: len(partition_by)], named[len(partition_by) :]
    tagged = df.withColumns({bucket: range_bucket(df, keys, buckets)} | {g: Cell(df, c).identity for g, c in zip(groups, partition_by)})
    present = F.when(cell.present, cell.raw)
    pick = F.max_by if forward else F.min_by
    edges = tagged.groupBy(*groups, bucket).agg(pick(present, F.when(cell.present, position(df, keys))).alias(edge))
    ranges = SortKey(F.col(bucket), ascending=forward).ordered()
    before = Window.partitionBy(*groups).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    inherited = edges.select(
        *[F.col(g).alias(r) for g, r in zip(groups, their_groups)],
        F.col(bucket).alias(their_bucket),
        F.last(edge, ignorenulls=True).over(before).alias(inherited_name),
    )
    if not groups:
        inherited = F.broadcast(inherited)
    match = F.col(bucket) == F.col(their_bucket)
    for g, r in zip(groups, their_groups):
        match = match & F.col(g).eqNullSafe(F.col(r))
    joined = tagged.join(inherited, match, "left")
    within = Window.partitionBy(*groups, bucket).orderBy(
        *[(k if forward else k.reversed()).ordered() for k in keys]
    )
    near = F.last(present, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = F.when(cell.missing, F.coalesce(near, F.col(inherited_name), cell.raw)).otherwise(cell.raw)
    return joined.select(
        *[filled.alias(c, metadata=df.schema[c].metadata) if c == cell.name else col(c) for c in df.columns]
    )
