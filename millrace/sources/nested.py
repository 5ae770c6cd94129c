"""JSON arrays and ``{"rows": [...]}`` documents of any size, taken apart into their objects in splits.

A file is read as the pieces between closing braces, which a scan deals out by byte ranges whatever the line ends. Whether a
piece begins inside a string, and how deep, depends on all text before it: each split turns one of two states (outside,
inside a string) into another and adds to the depth. These turns, one small row a split, are composed along each file, and
every split then knows how it begins. Objects inside a split are put together there, those that cross splits afterwards.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.quoted import BROADCAST_SPLITS
from millrace.sources.scratch import settled

#: What stands before the first object, by how deep objects are, and behind the last one.
HEADS = {1: r"\A\s*\[\s*\z", 2: r'\A\s*\{\s*"rows"\s*:\s*\[\s*\z'}
TAILS = {1: r"\A\s*\]\s*\z", 2: r"\A\s*\]\s*\}\s*\z"}


def _pieces(spark: SparkSession, files: list[str]) -> DataFrame:
    pieces = spark.read.option("lineSep", "}").text(files)
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "size": F.col("_metadata.file_size")}
    return pieces.select(*[c.alias(n) for n, c in place.items()], "value", F.monotonically_increasing_id().alias("at"))


def _scanner():
    """A piece's brackets outside strings, as (place, character), whether it ends inside a string, and whether all strings are sound."""
    import re

    token = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[\[\]{]', re.DOTALL)
    closing, control = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.DOTALL), re.compile(r"[\x00-\x1f]").search

    def scan(piece: str, inside: bool):
        at, found, doubt, sound = 0, [], control(piece) is not None, True
        if inside:
            m = closing.match(piece)
            sound = not (doubt and control(piece, 0, m.end()))
            if not m[1]:
                return found, True, sound
            at = m.end()
        for m in token.finditer(piece, at):
            if piece[m.start()] == '"':
                sound = sound and not (doubt and control(piece, m.start(), m.end()))
                if not m[1]:
                    return found, True, sound
            else:
                found.append((m.start(), piece[m.start()]))
        return found, False, sound

    return scan


def _turns():
    scan = _scanner()

    def run(batches):
        split, turn = None, None

        def row():
            (a, da), (b, db) = turn
            columns = [pa.array([split[0]]), pa.array([split[1]], pa.int64()), pa.array([a]), pa.array([b]), pa.array([da], pa.int64()), pa.array([db], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "outside", "inside", "deeper_outside", "deeper_inside"])

        def step(state, piece):
            inside, depth = state
            found, inside, _ = scan(piece, inside)
            # The brace behind the piece closes an object unless it is in a string.
            return inside, depth + sum(-1 if c == "]" else 1 for _, c in found) - (not inside)

        for batch in batches:
            for file, block, piece in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if (file, block) != split:
                    if split is not None:
                        yield row()
                    split, turn = (file, block), ((False, 0), (True, 0))
                turn = step(turn[0], piece), step(turn[1], piece)
        if split is not None:
            yield row()

    return run


def _composed(table: pa.Table) -> pa.Table:
    splits, inside, depth, begins, depths = table.sort_by("block").to_pylist(), False, 0, [], []
    for s in splits:
        begins.append(inside)
        depths.append(depth)
        depth += s["deeper_inside"] if inside else s["deeper_outside"]
        inside = s["inside"] if inside else s["outside"]
    blocks = pa.array([s["block"] for s in splits], pa.int64())
    return pa.table({"file": pa.array([s["file"] for s in splits]), "block": blocks, "begins": pa.array(begins, pa.bool_()), "depth": pa.array(depths, pa.int64())})


def _objects(level: int):
    """Objects of each split with the text before them: ``part`` 0 is whole, 1 goes on, -1 is a rest, 2 the text behind all."""
    scan = _scanner()

    def run(batches):
        split, inside, depth, held, part, gap, n, out = None, False, 0, [], 0, [], 0, []

        def close(kind):
            nonlocal held, part, gap, n
            out.append((*split, n, part or kind, "".join(gap), "".join(held)))
            held, part, gap, n = [], 0, [], n + 1

        def ended():
            if held:
                close(1)
            if gap:
                close(2)

        def emitted():
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "block", "n", "part", "gap", "record"])
            out.clear()
            return batch

        for batch in batches:
            for file, block, begins, begins_at, piece in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (file, block) != split:
                    ended()
                    split, inside, depth, n = (file, block), begins, begins_at, 0
                    if depth > level:
                        held, part = [""], -1
                found, inside, sound = scan(piece, inside)
                start = 0
                if not sound:  # a gap that never fits
                    gap.append("\0")
                for at, c in found:
                    if c == "{" and depth == level and not held:
                        gap.append(piece[:at])
                        held, start = [""], at
                    depth += -1 if c == "]" else 1
                piece = piece + "}"
                depth -= not inside
                (held if held else gap).append(piece[start:])
                if held and depth == level and not inside:
                    close(0)
            if out:
                yield emitted()
        ended()
        if out:
            yield emitted()

    return run


def split_objects(spark: SparkSession, files: list[str], level: int) -> tuple[DataFrame, list[str]]:
    """``file``, ``block``, ``n``, ``record``: the objects at a depth of ``level``, and the files that are not made so throughout."""
    pieces = _pieces(spark, files)
    turns = pieces.select("file", "block", "value").mapInArrow(
        _turns(), "file string, block long, outside boolean, inside boolean, deeper_outside long, deeper_inside long"
    )
    states = settled(turns.groupBy("file").applyInArrow(_composed, "file string, block long, begins boolean, depth long"), "json-splits")
    if states.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        marked = pieces.join(F.broadcast(states), ["file", "block"])
    else:
        marked = pieces.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    schema = "file string, block long, n long, part int, gap string, record string"
    parts = marked.select("file", "block", "begins", "depth", "value").mapInArrow(_objects(level), schema)
    parts = settled(parts, "json-objects")
    # Parts of objects that cross splits: two of each split at most. A whole one is where it began.
    crossing = parts.where("part IN (1, -1)")
    in_order = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    chained = crossing.withColumn("chain", F.count_if(F.col("part") == 1).over(in_order))
    first = F.min(F.struct("block", "n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "record"))), lambda x: x["record"]), "")
    joined = chained.groupBy("file", "chain").agg(first.alias("first"), text.alias("record")).select("file", "first.block", "first.n", "record")
    whole = parts.where("part = 0").select("file", "block", "n", "record").unionByName(joined.select("file", "block", "n", "record"))
    # Between two objects of a split stands a comma. A gap at the end of a split goes on before the first object of the next.
    edge = (F.col("part") == 2) | ((F.col("n") == 0) & (F.col("part") >= 0))
    gap_fits = F.when(F.col("part") == -1, F.col("gap") == "").otherwise(F.col("gap").rlike(r"\A\s*,\s*\z"))
    inner = parts.where(~edge).groupBy("file").agg(F.bool_and(gap_fits).alias("fits"))
    edges = parts.where(edge).select("file", "block", "n", "gap", F.when(F.col("part") == 2, 0).otherwise(1).alias("object"))
    earlier = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    in_order = F.array_sort(F.collect_list(F.struct("block", "n", "gap")))
    gaps = edges.withColumn("run", F.coalesce(F.sum("object").over(earlier), F.lit(0))).groupBy("file", "run")
    gaps = gaps.agg(F.array_join(F.transform(in_order, lambda x: x["gap"]), "").alias("gap"), F.max("object").alias("object"))
    # The last piece of a file may have got a brace that is not there.
    ends = pieces.groupBy("file").agg((F.sum(F.octet_length("value")) + F.count("*") - F.first("size")).alias("added"))
    last = gaps.groupBy("file").agg(F.max("run").alias("last"))
    judged = gaps.join(ends, "file").join(last, "file")
    tail = F.when(F.col("added") == 1, F.regexp_replace("gap", r"\}\z", "")).otherwise(F.col("gap"))
    fits = (
        F.when(F.col("run") == F.col("last"), (F.col("object") == 0) & (F.col("run") > 0) & tail.rlike(TAILS[level]))
        .when(F.col("run") == 0, F.col("gap").rlike(HEADS[level]))
        .otherwise(F.col("gap").rlike(r"\A\s*,\s*\z"))
    )
    verdicts = judged.groupBy("file").agg(F.bool_and(fits).alias("fits")).unionByName(inner)
    odd = [r[0] for r in verdicts.where("NOT fits").select("file").distinct().orderBy("file").collect()]
    return whole, odd
