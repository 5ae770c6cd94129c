"""Global order without one giant task.

A window over a whole table runs in a single task. The helpers here cut the table into ranges of its sort order
instead: a small sample gives the cut points, every row finds its range with a binary search over them inside one
column expression, and windows run per range. The cut points only decide how evenly the work spreads. Any set of cut
points gives the same, exact result, and rows that tie on the leading key are still told apart by the later keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.cells import bind, col, fresh, is_integral

ROWS_PER_BUCKET = 1_000_000  # a range of this many rows is an ordinary sort for one task
MAX_BUCKETS = 32_768
SAMPLES_PER_BUCKET = 16
CUT_TEXT = 64  # characters of a text key in a cut point: any cut points do, so long keys never reach the driver


@dataclass(frozen=True)
class SortKey:
    """One sort expression. Nulls come first ascending and last descending, as Spark orders them by default."""

    expr: Column
    ascending: bool = True
    collation: str | None = None

    def _collated(self, c: Column) -> Column:
        return F.collate(c, self.collation) if self.collation else c

    @property
    def value(self) -> Column:
        return self._collated(self.expr)

    def ordered(self) -> Column:
        return self.value.asc_nulls_first() if self.ascending else self.value.desc_nulls_last()

    def reversed(self) -> SortKey:
        return SortKey(self.expr, not self.ascending, self.collation)

    def cut_is_before(self, cut: Column) -> Column:
        """Whether a cut value sorts strictly before this row's value."""
        cut = self._collated(cut)
        if self.ascending:
            return F.when(cut.isNull(), self.value.isNotNull()).otherwise(F.coalesce(cut < self.value, F.lit(False)))
        return F.when(self.value.isNull(), cut.isNotNull()).otherwise(F.coalesce(cut > self.value, F.lit(False)))

    def cut_is_equal(self, cut: Column) -> Column:
        return self._collated(cut).eqNullSafe(self.value)


def as_keys(df: DataFrame, order_by) -> list[SortKey]:
    """Sort keys from a column name, a list of names, or a list of keys."""
    items = [order_by] if isinstance(order_by, (str, SortKey)) else list(order_by or [])
    missing = [i for i in items if isinstance(i, str) and i not in df.columns]
    if not items or missing:
        raise ValueError(f"order_by must name existing columns; got {order_by!r}")
    return [SortKey(col(i)) if isinstance(i, str) else i for i in items]


def position(df: DataFrame, keys: list[SortKey]) -> Column:
    """The order of ascending keys as one comparable value that is never null, so that aggregations skip no row.

    A null key comes first. One whole-number key keeps a fixed width, which lets aggregations hash instead of sort.
    """
    if len(keys) == 1 and is_integral(df.select(keys[0].expr).schema[0].dataType):
        return F.coalesce(keys[0].expr.cast("decimal(20,0)"), F.lit("-1e19").cast("decimal(20,0)"))
    return F.struct(*[k.expr.alias(f"k{i}") for i, k in enumerate(keys)])


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def range_bucket(df: DataFrame, keys: list[SortKey], buckets: int | None = None) -> Column:
    """An expression giving each row the number of its range; ranges ascend in the keys' order.

    ``buckets`` is the least number of ranges: there are more if these would hold over ``ROWS_PER_BUCKET`` rows each.
    Two small jobs run here: a row count (only to size the sample) and the sample itself, whose size is bounded by
    the number of ranges and not by the table.
    """
    rows = df.count()
    buckets = min(MAX_BUCKETS, _power_of_two(max(1, buckets or 1, -(-rows // ROWS_PER_BUCKET))))
    if buckets == 1 or rows == 0:
        return F.lit(0)
    fraction = min(1.0, SAMPLES_PER_BUCKET * buckets / rows)
    values = df.select(*[k.expr.alias(f"k{i}") for i, k in enumerate(keys)])
    texts = [f.name for f in values.schema.fields if isinstance(f.dataType, StringType)]
    values = values.withColumns({c: F.substring(c, 1, CUT_TEXT) for c in texts}) if texts else values
    fields = ",".join(f"k{i}:{f.dataType.simpleString()}" for i, f in enumerate(values.schema.fields))
    in_order = [SortKey(F.col(f"k{i}"), k.ascending, k.collation).ordered() for i, k in enumerate(keys)]
    sample = [
        r[0] for r in values.sample(fraction, seed=17).orderBy(*in_order).select(F.to_json(F.struct("*"))).collect()
    ]
    if not sample:
        return F.lit(0)
    picks = [sample[i * len(sample) // buckets] for i in range(1, buckets)]
    cuts = F.from_json(F.lit("[" + ",".join(picks) + "]"), f"array<struct<{fields}>>")

    def passed(position: Column) -> Column:
        cut = F.element_at(cuts, position)
        test = F.lit(True)  # equal on every key: the row belongs behind the cut
        for i, key in reversed(list(enumerate(keys))):
            value = cut.getField(f"k{i}")
            test = key.cut_is_before(value) | (key.cut_is_equal(value) & test)
        return test

    steps, width = [], buckets // 2
    while width:
        steps.append(F.lit(width))
        width //= 2
    return F.reduce(
        F.array(*steps), F.lit(0), lambda found, step: F.when(passed(found + step), found + step).otherwise(found)
    )


def with_position(df: DataFrame, keys: list[SortKey], name: str = "pos", buckets: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in the keys' order.

    Rows are numbered within their range and shifted by the sizes of the ranges before it. The table of range sizes
    has at most ``MAX_BUCKETS`` rows, which is what makes broadcasting it and the window over it safe.
    """
    # Sort expressions become columns first: the search and the sort mention them many times.
    keyed, sorts = bind(df, *[k.expr for k in keys])
    keys = [SortKey(F.col(s), k.ascending, k.collation) for s, k in zip(sorts, keys)]
    bucket, size, offset, rank = fresh(keyed, "_bucket", "_size", "_offset", "_rank")
    tagged = keyed.withColumn(bucket, range_bucket(keyed, keys, buckets))
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(bucket).agg(F.count(F.lit(1)).alias(size))
    offsets = offsets.select(bucket, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(offset))
    within = Window.partitionBy(bucket).orderBy(*[k.ordered() for k in keys])
    numbered = tagged.withColumn(rank, F.row_number().over(within)).join(F.broadcast(offsets), bucket)
    return numbered.select(*[col(c) for c in df.columns], (F.col(offset) + F.col(rank)).alias(name))
