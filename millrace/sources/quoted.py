"""Delimited records whose cells run over line ends, read in splits.

Whether a line begins inside a quoted cell depends on all text before it. Each line, and so each split of a file, turns one of
two states (outside, inside) into another; the splits' turns, one small row each, are composed along each file, and every split
then knows how it begins. Records inside a split are put together there; of one that crosses into other splits, the parts are
joined by where it began. Python sees lines as Arrow batches and only scans those that hold a quote.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import settled

#: Up to so many splits, their first states are broadcast; beyond, lines are dealt by split.
BROADCAST_SPLITS = 200_000


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(files)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _scanner(sep: str):
    def after(line: str, inside: bool) -> bool:
        """Whether a quoted cell is open behind a line. A quote opens one only where a cell begins."""
        at = 0
        if not inside and not line.startswith('"'):
            at = line.find(sep + '"')
            if at < 0:
                return False
            at += len(sep)
        at += 0 if inside else 1
        while True:
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] != '"':
                    break
                at += 2
            at = line.find(sep, at + 1)
            if at < 0:
                return False
            if line[at + len(sep) : at + len(sep) + 1] != '"':
                at = line.find(sep + '"', at + len(sep))
                if at < 0:
                    return False
            at += len(sep) + 1

    return after


def _turns(sep: str):
    """Of each split: the states behind it, from either state before it, and whether its first line ends in a carriage return."""
    after = _scanner(sep)

    def run(batches):
        split, turn, ends = None, (False, True), False

        def row():
            columns = [pa.array([split[0]]), pa.array([split[1]], pa.int64()), pa.array([turn[0]]), pa.array([turn[1]]), pa.array([ends])]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "outside", "inside", "returns"])

        for batch in batches:
            files, blocks, values = batch.column(0), batch.column(1), batch.column(2)
            lo, n = 0, batch.num_rows
            while lo < n:
                here = files[lo].as_py(), blocks[lo].as_py()
                same = pc.and_(pc.equal(files.slice(lo), here[0]), pc.equal(blocks.slice(lo), here[1]))
                stop = pc.index(same, False).as_py()
                hi = n if stop < 0 else lo + stop
                if here != split:
                    if split is not None:
                        yield row()
                    split, turn, ends = here, (False, True), (values[lo].as_py() or "").endswith("\r")
                own = values.slice(lo, hi - lo)
                for line in own.filter(pc.match_substring(own, '"')).to_pylist():
                    turn = after(line, turn[0]), after(line, turn[1])
                lo = hi
        if split is not None:
            yield row()

    return run


def _composed(table: pa.Table) -> pa.Table:
    """Of each split of a file: whether it begins inside a cell, and whether the file's lines end in carriage returns."""
    splits, inside, begins = table.sort_by("block"), False, []
    for outside_to, inside_to in zip(splits.column("outside").to_pylist(), splits.column("inside").to_pylist()):
        begins.append(inside)
        inside = inside_to if inside else outside_to
    returns = pa.array([splits.column("returns")[0].as_py()] * len(begins), pa.bool_())
    return pa.table({"file": splits.column("file"), "block": splits.column("block"), "begins": pa.array(begins, pa.bool_()), "returns": returns})


def _joined(sep: str):
    """Records of each split, numbered: ``part`` 0 is whole, 1 goes on in the next split, -1 is the rest of one from before."""
    after = _scanner(sep)

    def run(batches):
        split, inside, held, part, n, out = None, False, [], 0, 0, []

        def close(last: int):
            nonlocal held, part, n
            text = "\n".join(held)
            kind = part if part else last
            if text or kind:
                out.append((*split, n, kind, text))
                n += kind >= 0
            held, part = [], 0

        def emitted():
            columns = list(zip(*out))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "n", "part", "record"])

        for batch in batches:
            for file, block, begins, returns, line in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (file, block) != split:
                    if held:
                        close(1 if inside else 0)
                    split, inside, part, n = (file, block), begins, -1 if begins else 0, 0
                # As the first line of a file ends, so do all; a cell keeps its line ends without carriage returns then.
                line = line.removesuffix("\r") if returns else line
                held.append(line)
                if '"' in line:
                    inside = after(line, inside)
                if not inside:
                    close(0)
            if out:
                yield emitted()
        if held:
            close(1 if inside else 0)
        if out:
            yield emitted()

    return run


def split_records(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """``file``, ``block``, ``n`` and ``record`` of all records that are not empty; the three give their order.

    The first record of a file has block 0 and number 0.
    """
    lines = _lines(spark, files)
    turns = lines.mapInArrow(_turns(sep), "file string, block long, outside boolean, inside boolean, returns boolean")
    states = settled(turns.groupBy("file").applyInArrow(_composed, "file string, block long, begins boolean, returns boolean"), "splits")
    marked = lines.withColumn("at", F.monotonically_increasing_id())
    if states.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        marked = marked.join(F.broadcast(states), ["file", "block"])
    else:
        marked = marked.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    schema = "file string, block long, n long, part int, record string"
    parts = marked.select("file", "block", "begins", "returns", "value").mapInArrow(_joined(sep), schema)
    # Parts of records that cross splits: two of each split at most. A record's number is where it began.
    crossing = settled(parts.where("part <> 0"), "crossing")
    in_order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    chained = crossing.withColumn("chain", F.count_if(F.col("part") == 1).over(in_order))
    first = F.min_by(F.struct("block", "n"), F.struct("block", "part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "record"))), lambda x: x["record"]), "\n")
    whole = chained.groupBy("file", "chain").agg(first.alias("first"), text.alias("record"))
    return parts.where("part = 0").drop("part").unionByName(whole.select("file", "first.block", "first.n", "record"))
