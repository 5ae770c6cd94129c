"""Best-fit packing of token sequences: large pieces matched in pairs, small ones best-fit into the gaps."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import CUT_CHARS, PIECES, ByteBpe
from millrace.llm.tables import settle, text_slices

CAPACITY, END_ID = 1024, 2
#: Offsets of (task, size) classes up to this many rows are broadcast, beyond it joined by a shuffle.
BROADCAST_CLASSES = 500_000
_FULL = 40


@lru_cache(2)
def _tokenizer(path: str) -> tuple[tiktoken.Encoding, Callable]:
    """The file's vocabulary under the library's fast encoder; ids are those of the file."""
    bpe = ByteBpe(path)
    ranks = {s: k for k, s in enumerate(bpe.strings) if k not in bpe.special.values()}
    return tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=bpe.special), bpe.cut.search


def _ids(path: str, text: str) -> np.ndarray:
    encoding, cut = _tokenizer(path)
    found, at = [], 0
    while len(text) - at > CUT_CHARS and (m := cut(text, at + CUT_CHARS)):
        found.append(encoding.encode(text[at : m.start()], allowed_special="all"))
        at = m.start()
    found.append(encoding.encode(text[at:] if at else text, allowed_special="all"))
    return np.concatenate([np.array(x, "<u4") for x in found]) if len(found) > 1 else np.array(found[0], "<u4")


def _pieces(path: str, capacity: int, end_id: int):
    """Tokens of each text cut into pieces. ``rank`` numbers a task's pieces of one length."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(1)):
                whole, ends = data.tobytes(), offsets.tolist()
                row, piece, start, length, rank, ids = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    tokens = np.append(_ids(path, whole[a:b].decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                    at = 0
                    for j in range(-(-len(tokens) // capacity)):
                        to = at + capacity if j else (len(tokens) - 1) % capacity + 1
                        row.append(lo + k), piece.append(j), start.append(at), length.append(to - at)
                        rank.append(seen[to - at]), ids.append(tokens[at:to].tobytes())
                        seen[to - at] += 1
                        at = to
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(np.full(len(row), part, np.int64)),
                        pa.array(rank, pa.int64()),
                    ],
                    ["id", "piece", "start", "length", "ids", "part", "rank"],
                )

    return run


class BinPlan:
    """Where the pieces of each length go, as runs: pieces ``[rank, rank + n)`` go to bins ``[bin, bin + n)`` at ``offset``.

    Made from the number of pieces of each length alone, so its size depends on the capacity, not on the data.
    """

    def __init__(self, counts: list[int], capacity: int):
        self.capacity, self.bins, self.runs = capacity, 0, []
        self._left, self._next = list(counts), [0] * (capacity + 1)
        self._gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self._match_large()
        for size in range(capacity // 3, 0, -1):
            self._fit_small(size)

    def _place(self, size: int, first: int, n: int, offset: int) -> None:
        self.runs.append((size, self._next[size], n, first, offset))
        self._next[size] += n
        self._left[size] -= n

    def _open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def _match_large(self) -> None:
        """From the largest down, each piece above a third takes the largest other one that fits beside it."""
        least = self.capacity // 3 + 1
        partner = self.capacity
        for size in range(self.capacity, least - 1, -1):
            while n := self._left[size]:
                partner = min(size, self.capacity - size)
                while partner >= least and self._left[partner] < (2 if partner == size else 1):
                    partner -= 1
                if partner < least:
                    first = self._open(n)
                    self._place(size, first, n, 0)
                    self._gaps[self.capacity - size].append((first, n))
                    break
                n = n // 2 if partner == size else min(n, self._left[partner])
                first = self._open(n)
                self._place(size, first, n, 0)
                self._place(partner, first, n, size)
                self._gaps[self.capacity - size - partner].append((first, n))

    def _fill(self, size: int, first: int, n: int, gap: int) -> None:
        """Put pieces into bins that have ``gap`` left, one bin after the other, each as full as it gets."""
        each = gap // size
        full = min(n, self._left[size] // each)
        for layer in range(each if full else 0):
            self._place(size, first, full, self.capacity - gap + layer * size)
        if full:
            self._gaps[gap - each * size].append((first, full))
        rest = full < n and min(self._left[size], each)
        for layer in range(rest or 0):
            self._place(size, first + full, 1, self.capacity - gap + layer * size)
        if rest:
            self._gaps[gap - rest * size].append((first + full, 1))
            full += 1
        if full < n:
            self._gaps[gap].append((first + full, n - full))

    def _fit_small(self, size: int) -> None:
        for gap in range(size, self.capacity):
            if not self._left[size]:
                return
            for first, n in self._gaps.pop(gap, []):
                self._fill(size, first, n, gap)
        if left := self._left[size]:
            n = -(-left // (self.capacity // size))
            self._fill(size, self._open(n), n, self.capacity)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length, first rank) of the runs, and by run: bin less first rank, offset."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << _FULL) + runs[:, 1], runs[:, 3] - runs[:, 1], runs[:, 4]


def pack(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Tokenize whole texts and pack them into sequences of at most ``capacity`` tokens.

    Each text's ids are followed by ``end_id``. A longer one is cut into pieces of ``capacity``, of which the first may be
    shorter; nothing else is cut. Pieces above a third of the capacity are paired by greedy matching, at most two to a
    sequence; smaller ones fill the gaps best-fit, the largest first.

    Returns per piece: the id, ``piece`` (from 0), ``start`` (ids of its text before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit integers), ``sequence_id`` and ``offset`` there. A null text is empty and gives a piece of the end id
    alone. Ids may be null or repeat (each row is packed), other columns are not read, an empty table gives an empty one.

    Only the counts by length (``capacity`` rows) reach the driver. Pieces of one length are numbered by task and by place in
    the task, so the most common length is no hot group.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids binary, part long, rank long"
    pieces = settle(rows.mapInArrow(_pieces(tokenizer, capacity, end_id), schema), "pieces")
    classes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    classes = settle(classes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-classes")
    counts = [0] * (capacity + 1)
    for r in classes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    keys, shift, offset = BinPlan(counts, capacity).arrays()
    few = classes.count() <= BROADCAST_CLASSES
    offsets = classes.select("part", "length", "before")
    ranked = pieces.join(F.broadcast(offsets) if few else offsets, ["part", "length"]).select(
        "id", "piece", "start", "length", "ids", (F.col("rank") + F.col("before")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            run = np.searchsorted(keys, (size << _FULL) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(rank + shift[run]), pa.array(offset[run])],
                ["id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    schema = f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id)
