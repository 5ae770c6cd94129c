"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import settle


#: Links of a task: few links are contracted by few tasks, so that small rounds don't pay for a whole shuffle each.
LINKS_PER_TASK = 100_000


def _stars(links: DataFrame, tasks: int) -> DataFrame:
    """One contraction: every node's larger neighbours, then its smaller ones, are linked to the least of all."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    large = (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("least", "a").alias("b")).where("a != b").distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("least"))
    moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b")
    return low.select("a", F.col("least").alias("b")).union(moved).coalesce(tasks).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (``a``, ``b``: long) but the roots, the least node of each component.

    The number of rounds grows with the logarithm of a component's width; each is written before the next. Self links and
    repeated links do no harm; an empty table gives an empty one.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links, before = settle(links, "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, links = state, settle(_stars(links, max(1, -(-state[0] // LINKS_PER_TASK))), "links")
