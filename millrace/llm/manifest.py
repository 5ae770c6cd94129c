"""A Merkle manifest of a dataset: one tree per group of rows, their roots under one root, and proofs of single rows.

Every tree is kept as content-addressed records, digest to children, of one table per height. A request for a leaf descends
from the root by the digits of its rank: at each node it selects one child and keeps the others, as a path segment. Requests
that still share all digits descend as one. Reversed, the segments lead from the leaf up to the root again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cells import col
from millrace.llm.tables import fresh, settle

FANOUT = 8
_BITS = FANOUT.bit_length() - 1
SEGMENT = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, or ``-`` for null, so that neighbours cannot be told otherwise."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _tree_of(group: Column) -> Column:
    """A group's tree: never null, and in the order of the groups (null first, then by UTF-8 bytes)."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` (from 0) and ``left`` (their number) of the rows of each ``tree``, ascending by ``order``, nulls first.

    Rows are sorted in ranges and counted per range, so a tree that holds most rows is no single task.
    """
    keys = ["tree", *order]
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "at": within})
    placed = settle(placed, "manifest-order")
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    parts = parts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("left"),
    )
    return placed.join(parts, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


@dataclass(frozen=True)
class Forest:
    """Trees over ranked leaves. ``roots``: tree, digest, left (its leaves); ``records``: of each height, digest to children."""

    roots: DataFrame
    records: list[DataFrame]


def grown(leaves: DataFrame, name: str) -> Forest:
    """The trees over ``tree``, ``rank``, ``left`` and ``digest``: runs of ``FANOUT`` nodes become one, while there are several."""
    level = leaves.select("tree", "rank", F.col("left").alias("leaves"), "left", "digest")
    most = level.agg(F.max("left")).first()[0] or 0
    roots, records = level.where("left = 1"), []
    while most > 1:
        child = F.struct("rank", "digest")
        parents = level.where("left > 1").groupBy("tree", "leaves", F.shiftright("rank", _BITS).alias("rank"), F.ceil(F.col("left") / FANOUT).alias("left"))
        parents = parents.agg(F.array_sort(F.collect_list(child))["digest"].alias("children"))
        level = settle(parents.withColumn("digest", digest(F.array_join("children", ""))), f"{name}-height-{len(records) + 1}")
        # Equal nodes are one record.
        records.append(level.select("digest", "children").dropDuplicates(["digest"]))
        roots = roots.unionByName(level.where("left = 1").select(roots.columns))
        most = -(-most // FANOUT)
    return Forest(roots.select("tree", "digest", F.col("leaves").alias("left")), records)


def _height(leaves: Column, most: int) -> Column:
    """How often runs of nodes have to be joined until one is left; ``most`` is the height of the tallest tree."""
    taller = [F.when(leaves > FANOUT**k, 1).otherwise(0) for k in range(most)]
    return sum(taller, F.lit(0))


def descents(starts: DataFrame, forest: Forest, requests: DataFrame, name: str) -> DataFrame:
    """Requested leaves (``tree``, ``rank``, ``left`` and more) with ``path``, from ``starts`` at the trees' roots.

    ``starts``: tree, digest, left and ``path``, the segments that led there. A path is as deep as its tree is high.
    """
    most = len(forest.records)
    waiting = starts.withColumn("height", _height(F.col("left"), most)).select("tree", F.lit(0).cast("long").alias("prefix"), "digest", "path", "height")
    front = waiting.where(F.col("height") == most).drop("height")
    alone = requests.where("left = 1").join(waiting.where("height = 0").select("tree", "path"), "tree")
    for height in range(most, 0, -1):
        nodes = front.join(forest.records[height - 1], "digest").select("tree", "prefix", "path", "children")
        # Requests that agree on all digits so far are one; each names the child it goes on to by its next digit.
        if height > 1:
            wanted = requests.where("left > 1").select("tree", F.shiftright("rank", _BITS * (height - 1)).alias("next")).distinct()
        else:
            wanted = requests.where("left > 1").withColumn("next", F.col("rank"))
        digit = F.col("next").bitwiseAND(FANOUT - 1).cast("int")
        others = F.struct(
            F.array_join(F.slice("children", F.lit(1), digit), "").alias("before"),
            F.array_join(F.slice("children", digit + 2, F.size("children")), "").alias("after"),
        )
        reached = wanted.withColumn("prefix", F.shiftright("next", _BITS)).join(nodes, ["tree", "prefix"])
        reached = reached.withColumns({"chosen": F.get("children", digit), "path": F.concat("path", F.array(others))}).where("chosen IS NOT NULL")
        if height == 1:
            return reached.select(*requests.columns, "path").unionByName(alone)
        front = reached.select("tree", F.col("next").alias("prefix"), F.col("chosen").alias("digest"), "path")
        front = front.unionByName(waiting.where(F.col("height") == height - 1).drop("height"))
        front = settle(front, f"{name}-front-{height - 1}")
    return alone


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its segments, from the leaf upwards, lead to."""
    return F.aggregate(segments, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(rows: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """``rows`` with ``leaf``, ``subroot``, ``root`` and ``segments``, the siblings from each leaf upwards to the root.

    ``leaf`` is a row's digest. Of each ``group`` (null is one, too), leaves ascend by ``order``, nulls first, rows with
    one value of it by their digest. Every ``FANOUT`` neighbours become one node, until one is left, the subroot; subroots
    ascend by group and become one root likewise. A group of one row has its leaf as subroot, one group its subroot as root.
    A segment has the concatenated digests ``before`` and ``after`` the node in its run. Equal rows are leaves of their own.
    An empty table gives an empty one. Columns of any name are passed on (the four get underscores before them where a
    column has that name) and moved with their rows: leave out texts, whatever their length, once ``leaf`` covers them.
    """
    names, kept = fresh(rows, "leaf", "subroot", "root", "segments"), F.struct(*[col(c) for c in rows.columns])
    leaves = rows.select(kept.alias("row"), _tree_of(col(group)).alias("tree"), col(order).alias("by"), leaf.alias("digest"))
    leaves = settle(ranked(settle(leaves, "manifest-leaves"), ["by", "digest"]), "manifest-ranks")
    forest = grown(leaves, "manifest")
    subroots = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.col("left").alias("leaves"))
    subroots = settle(ranked(subroots, ["name"]), "manifest-subroots")
    top = grown(subroots, "manifest-top")
    start = top.roots.withColumn("path", F.array().cast(f"array<{SEGMENT}>"))
    # A leaf of the upper tree is the root of a group's tree.
    starts = descents(start, top, subroots, "manifest-top").select(F.col("name").alias("tree"), "digest", F.col("leaves").alias("left"), "path")
    starts = settle(starts, "manifest-starts")
    root = top.roots.select("digest").first()
    found = descents(starts, forest, leaves, "manifest").join(starts.select("tree", F.col("digest").alias("subroot")), "tree")
    found = found.withColumns({"root": F.lit(root[0] if root else None).cast("string"), "segments": F.reverse("path")})
    return found.select("row.*", *[F.col(c).alias(n) for c, n in zip(("digest", "subroot", "root", "segments"), names)])
