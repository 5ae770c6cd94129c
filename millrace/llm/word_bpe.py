"""Byte-level BPE by a shuffle of distinct words: every word is encoded once, wherever and however often it occurs.

Texts fall into words (pre-tokens) with positions. A block of texts keeps, for each position, the number of the word there, and
its distinct words leave it in buckets, by the word's hash. A bucket meets the same bucket of all other blocks in one task,
which encodes each word once; the ids go back to the blocks and are put in the places of their words. A word leaves a block
once at most, so no word, however common, is a large part of the rows that are shuffled. Decoding joins ids with the table of
token bytes inside the task that holds them, as that table is no larger than the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import col
from millrace.sources.scratch import scratch_path

#: Bytes of text in a block, and in all blocks for each bucket of words; the number of buckets is kept within bounds.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 1 << 23, 1 << 24, (1024, 8192)
#: Longer texts are cut where a word is sure to end, so that lists of words stay small.
PART_CHARS = 1 << 20
#: Words a task remembers with their ids, and the longest that is.
KNOWN_WORDS, KNOWN_SIZE = 500_000, 64


def token_bytes(ranks: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    with open(ranks, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@lru_cache(2)
def _vocabulary(ranks: str) -> tuple[dict[bytes, int], pa.Array]:
    """Of a Python worker, read once: ids by bytes, and the token-byte table."""
    tokens = token_bytes(ranks)
    return {token: k for k, token in enumerate(tokens) if token}, pa.array(tokens, pa.large_binary())


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: neighbours of the lowest rank merge first, the leftmost of equals.

    A part is named by its start. The heap holds a merge for each two parts that have stood side by side; one whose parts
    have changed since is skipped. n bytes take O(n log n).
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (left := before[i]) >= 0 and (rank := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (rank, left, stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes in planes, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


class _Block(dict):
    """Texts with the numbers of their words. As a dict: the number of each word, in order of first occurrence."""

    def __init__(self):
        super().__init__()
        self.rows: list[pa.Array] = []
        self.counts, self.numbers, self.size = [], array("I"), 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number

    def record(self, name: int, buckets: int) -> pa.RecordBatch:
        words = [word.encode() for word in self]
        bucket = np.fromiter((zlib.crc32(word) % buckets for word in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        sizes, lists = np.fromiter(map(len, words), np.int64, len(words))[order], []
        for lo, hi in zip(cuts, [*cuts[1:], len(words)]):
            own = b"".join(map(words.__getitem__, order[lo:hi]))
            lists.append({"bucket": int(bucket[order[lo]]), "sizes": _packed(sizes[lo:hi]), "bytes": zstandard.compress(own, 1)})
        ids = pa.concat_arrays(self.rows)
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("sizes", pa.binary()), ("bytes", pa.binary())]))
        columns = {
            "block": pa.array([name], pa.int64()),
            "docs": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "counts": pa.array([self.counts], pa.list_(pa.int64())),
            "numbers": pa.array([_packed(np.frombuffer(self.numbers, np.uint32))], pa.binary()),
            "buckets": pa.array([_packed(bucket)], pa.binary()),
            "words": pa.array([lists], kind),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _parts(text: str, cut: regex.Pattern) -> Iterator[str]:
    at = 0
    while len(text) - at > PART_CHARS and (m := cut.search(text, at + PART_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _blocks(pattern: str, buckets: int, size: int):
    """Texts to blocks of about ``size`` bytes; a longer text is a block of its own."""

    def run(batches):
        words, cut = regex.compile(pattern).findall, regex.compile(r"(?<=\S) (?=\S)")
        block, made = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, lo = batch.column(0), batch.column(1).cast(pa.large_binary()), 0
            for k in range(batch.num_rows):
                text, before = texts[k].as_py() or b"", len(block.numbers)
                for part in _parts(text.decode("utf-8", "replace"), cut):
                    block.numbers.extend(map(block.__getitem__, words(part)))
                block.counts.append(len(block.numbers) - before)
                block.size += len(text) + 8
                if block.size >= size:
                    block.rows.append(ids.slice(lo, k + 1 - lo))
                    lo = k + 1
                    yield block.record(made, buckets)
                    block, made = _Block(), made + 1
            if lo < batch.num_rows:
                block.rows.append(ids.slice(lo))
        if block.counts:
            yield block.record(made, buckets)

    return run


def _encoding(ranks: str):
    """The ids of the words of a block's bucket. A task has whole buckets, and remembers what it has encoded."""

    def run(batches):
        known, (ids_of, _) = {}, _vocabulary(ranks)
        for batch in batches:
            sizes_out, ids_out = [], []
            for k in range(batch.num_rows):
                stops = np.cumsum(_numbers(batch.column(2)[k].as_py())).tolist()
                whole, at, found = zstandard.decompress(batch.column(3)[k].as_py()), 0, []
                for stop in stops:
                    word = whole[at:stop]
                    at = stop
                    ids = known.get(word)
                    if ids is None:
                        ids = merged(word, ids_of)
                        if len(word) <= KNOWN_SIZE:
                            if len(known) >= KNOWN_WORDS:
                                known.clear()
                            known[word] = ids
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                sizes_out.append(_packed(sizes))
                ids_out.append(_packed(np.array([i for ids in found for i in ids], np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(sizes_out, pa.binary()), pa.array(ids_out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "sizes", "ids"])

    return run


def _joined_bytes(ids: np.ndarray, bounds: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The bytes of the tokens of each stretch of ids, by a join with the token-byte table."""
    found = tokens.take(pa.array(ids))
    offsets = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets[bounds].tobytes()), found.buffers()[2]]).cast(pa.binary())


def _placed(ranks: str, decoding: bool):
    """Ids in the places of their words, and the bytes they stand for."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                docs, counts, numbers, buckets, lists = (batch.column(c)[k] for c in range(5))
                # Words are numbered by first occurrence, lists come by bucket: the order within one is the same.
                numbers, bucket = _numbers(numbers.as_py()), _numbers(buckets.as_py())
                lists = sorted(lists.as_py(), key=lambda x: x["bucket"])
                sizes = [_numbers(x["sizes"]) for x in lists]
                ids = np.concatenate([_numbers(x["ids"]) for x in lists] or [np.zeros(0, "<u4")]).astype(np.int32)
                size = np.empty(len(bucket), np.int64)
                order = np.argsort(bucket, kind="stable")
                size[order] = np.concatenate(sizes) if sizes else 0
                start = np.empty(len(bucket), np.int64)
                start[order] = np.cumsum(size[order]) - size[order]
                own = size[numbers]
                ends = np.cumsum(own)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[numbers] - (ends - own), own)
                ids = ids[at]
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts.values.to_numpy())])]
                columns = [docs.values, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if decoding:
                    columns.append(_joined_bytes(ids, bounds, _vocabulary(ranks)[1]))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    return run


def _written(blocks: DataFrame) -> DataFrame:
    """``blocks`` as a table bucketed like a shuffle by ``block``: what comes back to a block is shuffled, the block is not.

    Its files are below ``spark.checkpoint.dir``, its name is one of its own in the session's catalog.
    """
    spark = blocks.sparkSession
    path = scratch_path(spark, "word-blocks")
    name = path.rpartition("/")[2].replace("-", "_")
    blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def encode_words(
    docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text", decoded: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Token ids of every whole text: the id and ``ids`` (array of int); ``decoded`` adds the bytes that the ids stand for.

    ``ranks``: a file of base64 tokens and ranks, at a path every executor has; ``pattern`` cuts texts into words. A null or
    empty text has no ids. Ids may be null or repeat, as may texts, other columns are not read, an empty table gives an
    empty one. A text may be of any length; one above ``block_bytes`` is handled alone, so a task needs some ten times the
    bytes of the longest text.
    """
    rows = docs.select(col(id).alias("id"), col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = min(BUCKETS[1], max(BUCKETS[0], total // BUCKET_BYTES))
    lists = "array<struct<bucket:int,sizes:binary,bytes:binary>>"
    schema = f"block long, docs array<{kind}>, counts array<long>, numbers binary, buckets binary, words {lists}"
    blocks = _written(rows.mapInArrow(_blocks(pattern, buckets, block_bytes), schema))
    words = blocks.select("block", F.inline("words")).repartition("bucket")
    encoded = words.mapInArrow(_encoding(ranks), "block long, bucket int, sizes binary, ids binary")
    back = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("lists"))
    whole = blocks.select("block", "docs", "counts", "numbers", "buckets").join(back.hint("merge"), "block", "left")
    empty = F.array().cast("array<struct<bucket:int,sizes:binary,ids:binary>>")
    whole = whole.select("docs", "counts", "numbers", "buckets", F.coalesce("lists", empty).alias("lists"))
    out = whole.mapInArrow(_placed(ranks, decoded), f"id {kind}, ids array<int>" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id)


def _decoding(ranks: str):
    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _joined_bytes(lists.flatten().to_numpy(), bounds, _vocabulary(ranks)[1])], ["id", "decoded"])

    return run


def decode_words(tokens: DataFrame, ranks: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The bytes of every row's ids: the id and ``decoded``. Null lists give no bytes; an id outside the table fails."""
    rows = tokens.select(col(id).alias("id"), F.coalesce(col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoding(ranks), f"id {rows.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id)
