"""Exact order statistics of a distributed column.

Spark's exact percentile functions gather every distinct value in one task, and its approximate ones are off by some
ranks. Here an approximate sketch only proposes an interval around the wanted rank; exact counts confirm that the rank
lies inside, the interval shrinks until few distinct rows are left, and those are counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 4 / ACCURACY  # the sketch's rank error is at most 1 / ACCURACY
SETTLE_ROWS = 50_000  # an interval with at most this many rows is finished by counting its values


def order_statistics(values: DataFrame, ranks_of: Callable[[int], list[int]]) -> tuple[int, list[float]]:
    """Row count of the single column ``x`` and its values at the 0-based ranks ``ranks_of(count)``.

    Null rows are ignored. Each round is one aggregation with mergeable state; what returns to the driver is a handful
    of numbers, and in the last round at most ``SETTLE_ROWS`` value counts per rank.
    """
    values = values.filter(F.col("x").isNotNull())
    facts = values.agg(F.count("x"), F.min("x"), F.max("x")).head()
    n = facts[0]
    if n == 0:
        return 0, []
    wanted = list(ranks_of(n))
    answers: dict[int, float] = {}
    spans = {r: (facts[1], facts[2], 0, n) for r in set(wanted)}  # low, high, rows below low, rows inside
    while spans:
        done = {r for r, (low, high, _, inside) in spans.items() if low == high or inside <= SETTLE_ROWS}
        for r in done:
            low, high, below, _ = spans.pop(r)
            answers[r] = low if low == high else _settle(values, low, high, r - below)
        if spans:
            spans = _narrow(values, spans)
    return n, [answers[r] for r in wanted]


def _settle(values: DataFrame, low: float, high: float, offset: int) -> float:
    inside = values.filter(F.col("x").between(low, high))
    counts = inside.groupBy("x").count().orderBy("x").collect()
    reached = accumulate(c["count"] for c in counts)
    return next(c["x"] for c, total in zip(counts, reached) if total > offset)


def _narrow(values: DataFrame, spans: dict) -> dict:
    """One round for all ranks: propose a sub-interval each, count around it, keep the part that holds the rank."""
    x, ranks = F.col("x"), list(spans)
    sketches = []
    for r in ranks:
        low, high, below, inside = spans[r]
        at = (r - below + 0.5) / inside
        around = [max(0.0, at - MARGIN), at, min(1.0, at + MARGIN)]
        sketches.append(F.percentile_approx(F.when(x.between(low, high), x), around, ACCURACY))
    proposals, counts = {}, []
    for r, (lo, middle, hi) in zip(ranks, values.agg(*sketches).head()):
        low, high, *_ = spans[r]
        if (lo, hi) == (low, high):  # nothing gained: split at one value, which always removes it or finds it
            lo = hi = middle
        proposals[r] = (lo, hi)
        counts += [
            F.count_if((x >= low) & (x < lo)),
            F.count_if(x.between(lo, hi)),
            F.max(F.when((x >= low) & (x < lo), x)),
            F.min(F.when((x > hi) & (x <= high), x)),
        ]
    counted = values.agg(*counts).head()
    narrowed = {}
    for i, r in enumerate(ranks):
        (lo, hi), (low, high, below, inside) = proposals[r], spans[r]
        under, within, last_under, first_over = counted[4 * i : 4 * i + 4]
        if r < below + under:
            narrowed[r] = (low, last_under, below, under)
        elif r < below + under + within:
            narrowed[r] = (lo, hi, below + under, within)
        else:
            narrowed[r] = (first_over, high, below + under + within, inside - under - within)
    return narrowed
