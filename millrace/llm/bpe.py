"""Byte-level BPE: merges by a priority queue over a linked list of symbols, decoding by joining vocabulary strings."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import text_slices

#: Fixed pattern of the byte-level format: how a text falls into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered per Python worker, and the longest that is: at most about 100 MB.
KNOWN_PIECES, KNOWN_SIZE = 400_000, 64
#: Longer texts are cut where a piece is sure to end, so that the list of pieces stays small.
CUT_CHARS = 1 << 20


def _byte_characters() -> list[str]:
    """The format's printable stand-in for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteBpe(dict):
    """A tokenizer file's vocabulary. As a dict: the packed ids of each piece seen."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, stand_ins = spec["model"]["vocab"], _byte_characters()
        byte_of = {c: b for b, c in enumerate(stand_ins)}
        self.first = [vocabulary[c] for c in stand_ins]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.strings = [b""] * size
        for word, k in vocabulary.items():
            self.strings[k] = bytes(byte_of[c] for c in word)
        for word, k in self.special.items():
            self.strings[k] = word.encode()
        self.pieces = regex.compile(PIECES).findall
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece.

        The queue holds a merge for each pair that has stood side by side. An entry is stale if the symbols at its place no
        longer merge into what it was pushed for; it is skipped when it comes up. n bytes take O(n log n).
        """
        symbols = [self.first[b] for b in piece]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            if symbols[i] < 0 or (j := after[i]) < 0:
                continue
            now = merges.get((symbols[i], symbols[j]))
            if now is None or now[1] != new:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, symbols[k])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            if (k := before[i]) >= 0 and (found := merges.get((symbols[k], new))):
                heapq.heappush(queue, (found[0], k, found[1]))
        return [s for s in symbols if s >= 0]

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merged(piece.encode()), "<u4").tobytes()
        if len(piece) <= KNOWN_SIZE:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CUT_CHARS and (m := self.cut.search(text, at + CUT_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special strings in the text become their ids."""
        known, found = self.__getitem__, []
        for k, stretch in enumerate(self.split(text)) if self.special else [(0, text)]:
            if k % 2:
                found.append(np.uint32(self.special[stretch]).astype("<u4").tobytes())
            else:
                found += [b"".join(map(known, self.pieces(part))) for part in self._parts(stretch)]
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a Python worker, read once."""
    return ByteBpe(path)


def _encoding(path: str, decoding: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                whole, ends = data.tobytes(), offsets.tolist()
                ids = [bpe.encode(whole[a:b].decode("utf-8", "replace")) for a, b in zip(ends, ends[1:])]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())]
                if decoding:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    return run


def _decoding(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return run


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: the id and ``ids`` (little-endian unsigned 32-bit integers).

    ``tokenizer``: a byte-level BPE file, at a path every executor has. ``decoded`` adds the text that the ids stand for, made
    in the same pass. A null or empty text has no ids. Ids may be null or repeat, other columns are not read, an empty table
    gives an empty one, and a text may be of any length: the work on it grows as n log n, one slice of texts at a time.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids binary" + ", decoded string" * decoded
    return rows.mapInArrow(_encoding(tokenizer, decoded), schema).withColumnRenamed("id", id)


def decode(tokens: DataFrame, tokenizer: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of every row's ids: the id and ``decoded``. Null ids give an empty text, bytes that are no UTF-8 U+FFFD."""
    rows = tokens.select(F.col(id).alias("id"), F.col(ids).cast("binary").alias("ids"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, decoded string"
    return rows.mapInArrow(_decoding(tokenizer), schema).withColumnRenamed("id", id)
