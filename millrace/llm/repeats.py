"""Long repeats found by threshold-bounded interval expansion on Burrows-Wheeler transforms, shard by shard.

A repeat is a string of ``length`` bytes that starts in more than one place. Every such string has an anchor: the place of its
least hashed run of ``GRAM`` bytes. Equal strings have equal anchors, so repeats meet in the shard of their anchor's hash. Only
stretches around anchors that occur more than once are looked at, and equal stretches once, with the number of their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.llm.tables import fresh, settle, sized, text_slices
from millrace.llm.words import mixed

LENGTH, GRAM = 400, 64
#: Bytes of stretches in a shard, and in one anchor's group before it is split by the hash of whole strings.
SHARD_BYTES, GROUP_BYTES = 1 << 19, 1 << 19
#: A key with more rows than this is not dealt to one task.
HOT_ROWS = 5_000
#: A text is looked at in windows of so many bytes, which overlap by a repeat.
_WINDOW = 1 << 20

_RANDOM = np.random.default_rng(97)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hasher:
    """Hashes of any byte runs of an array, from running sums."""

    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if _Hasher._powers is None or len(_Hasher._powers[0]) < n:
            both = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (_STEP, _BACK)]
            _Hasher._powers = both[0], both[1]
        up, self.down = _Hasher._powers
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * up[: n - 1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        """Of every run of ``size`` bytes."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])


def _anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes that lie in one of the texts ending at ``ends``.

    Returns first and last start of the strings of each anchor, the anchor's place, and the hasher.
    """
    hasher, width = _Hasher(data), length - GRAM + 1
    grams = hasher.all(GRAM)
    count = len(grams)
    strings = len(data) - length + 1
    starts = np.concatenate([[0], ends[:-1]])
    if strings <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, hasher
    key = (grams >> np.uint64(24)) << np.uint64(24) | np.arange(count, dtype=np.uint64)
    padded = np.full(-(-count // width) * width, np.uint64(2**64 - 1))
    padded[:count] = key
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(right[:strings], left[width - 1 : width - 1 + strings])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.zeros(strings, bool)
    for a, b in zip(starts, ends):
        if b - a >= length:
            inside[a : b - length + 1] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, at, hasher
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], place[at[first]], hasher


def _anchored(length: int):
    """Rows of anchors: the text's key and size, first start, number of starts, and hashes of the anchor and around it."""
    half = (length - GRAM) // 2

    def rows(key, size, data, ends, row, base):
        lo, hi, place, hasher = _anchors(data, ends, length)
        gram = hasher(place, place + GRAM)
        stretch = mixed(hasher(lo, hi + length) ^ (place - lo).astype(np.uint64))
        # A string with its anchor far from its start holds the left stretch, any other the right one.
        left, right = lo <= place - half, hi > place - half
        before = hasher(np.where(left, place - half, place), place + GRAM)
        after = hasher(place, np.where(right, place + length - half, place))
        owner = row[np.searchsorted(ends, lo, "right")]
        signed = lambda x: pa.array(x.view(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                key.take(pa.array(owner)),
                size.take(pa.array(owner)),
                pa.array(lo - base[np.searchsorted(ends, lo, "right")]),
                pa.array((hi - lo + 1).astype(np.int32)),
                signed(gram),
                signed(stretch),
                pa.array(before.view(np.int64), mask=~left),
                pa.array(after.view(np.int64), mask=~right),
            ],
            ["key", "size", "lo", "n", "gram", "stretch", "before", "after"],
        )

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                key, size = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                if hi - lo > 1 or len(data) <= 2 * _WINDOW:
                    keep = np.flatnonzero(offsets[1:] > offsets[:-1])
                    if len(keep):
                        yield rows(key, size, data, offsets[1:][keep], keep, offsets[:-1][keep])
                else:  # one very long text, in windows; strings near a cut are looked at once
                    for at in range(0, max(1, len(data) - length + 1), _WINDOW):
                        part = data[at : at + _WINDOW + length - 1]
                        yield rows(key, size, part, np.array([len(part)]), np.array([0]), np.array([-at]))

    return run


def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling; ``text`` has bytes + 1, its ends 0x100."""
    n = len(text)
    # Seven symbols of nine bits to begin with.
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    shift, bits = 7, int(n).bit_length()
    while shift < depth:
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            break
        suffix = order[tied]
        # As many ranks as fit into one number: each round multiplies the sorted depth by that.
        ranks = 63 // bits
        key = rank[suffix]
        for k in range(1, ranks):
            after = suffix + k * shift
            key = key << bits | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[tied] = suffix = suffix[by]
        key = key[by]
        differs = np.ones(len(tied), bool)
        differs[1:] = key[1:] != key[:-1]
        new[tied] = differs
        start = np.flatnonzero(differs)
        rank[suffix] = np.repeat(tied[start], np.diff(np.append(start, len(tied))))
        shift *= ranks
    return order


def bounded_boundaries(text: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """Where neighbours in the suffix order share less than ``length`` symbols (``True`` at the second of the two).

    Breadth-first over intervals of the transform: those of strings of one symbol more are the backward extensions of those
    kept before. An interval whose right end has no common-prefix value yet gives it the current value and is kept; the search
    stops at ``length``. The end symbol is the largest and is never extended by, so no string crosses an end.
    """
    n, end = len(text), 0x100
    bwt = text[suffixes - 1]
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    to = np.empty(n, np.int32)
    to[by_symbol] = np.arange(n, dtype=np.int32)
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[bwt == end], after[bwt == end] = n, -1
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length):
        sizes = hi - lo
        total = int(sizes.sum())
        if not total:
            break
        at = np.arange(total, dtype=np.int32) + np.repeat(lo - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        # In its interval, a symbol's first place has no like place before it, its last none after it. Extensions are
        # disjoint intervals, so their ends in ascending order belong together.
        left = np.sort(to[at[before[at] < np.repeat(lo, sizes)]])
        right = np.sort(to[at[after[at] >= np.repeat(hi, sizes)]]) + 1
        kept = ~known[right]
        lo, hi = left[kept], right[kept]
        known[hi] = True
    return known[:n]


PIECE = "struct<gram:bigint,stretch:bigint,n:int,weight:bigint,at:int>"


def _repeated(length: int):
    """For the runs of a shard: which of their pieces' strings start in more than one place."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        chunks = table.column("bytes").combine_chunks().cast(pa.large_binary())
        pieces = table.column("pieces").combine_chunks()
        owner, flat = np.repeat(np.arange(len(pieces)), pieces.value_lengths().to_numpy()), pieces.flatten()
        n, weight, at = (flat.field(c).to_numpy().astype(np.int64) for c in ("n", "weight", "at"))
        _, offsets, data = chunks.buffers()
        offsets = np.frombuffer(offsets, np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        starts = offsets[:-1] - offsets[0] + np.arange(len(sizes))
        text = np.full(len(data) + len(sizes), 0x100, np.uint16)
        text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
        suffixes = _sorted_suffixes(text + np.uint16(1), length)
        group = np.cumsum(bounded_boundaries(text, suffixes, length), dtype=np.int32) - 1
        begin = starts[owner] + at
        own = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        places = np.zeros(len(text), np.int64)
        places[own] = np.repeat(weight, n)
        total = np.bincount(group, places[suffixes])
        twice = np.zeros(len(text), bool)
        twice[suffixes] = (total >= 2)[group]
        # Piece by piece, with a gap between them: spans never run from one into the next.
        place = np.repeat(np.arange(len(n)), n) + np.arange(len(own))
        flags = np.zeros(len(own) + len(n) + 1, np.int8)
        flags[place] = twice[own]
        steps = np.diff(flags, prepend=0)
        first, stop = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        heads = np.cumsum(n) - n + np.arange(len(n))
        piece = np.searchsorted(heads, first, "right") - 1
        return pa.table(
            {c: flat.field(c).take(pa.array(piece)) for c in ("gram", "stretch", "n")}
            | {"from": pa.array(first - heads[piece]), "to": pa.array(stop - heads[piece])}
        )

    return run


def _cut_out(length: int):
    """Runs of bytes from texts. Pieces that share their anchor with no other are cut together where they overlap."""

    def run(batches):
        for batch in batches:
            texts, takes = batch.column(1).cast(pa.binary()), batch.column(2)
            ends, flat = np.cumsum(takes.value_lengths().to_numpy()), takes.flatten()
            lo, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "n"))
            alone = flat.field("alone").to_numpy(zero_copy_only=False)
            shard, out, counts, order, offsets = [], [], [], [], []
            gram = flat.field("gram").to_numpy()
            for row in range(batch.num_rows):
                text, key = texts[row].as_py(), batch.column(0)[row].as_py()
                mine = np.arange(ends[row - 1] if row else 0, ends[row])
                mine = mine[np.argsort(lo[mine], kind="stable")]
                for k in mine[~alone[mine]].tolist():
                    shard.append(gram[k]), counts.append(1), order.append(k), offsets.append(0)
                    out.append(text[lo[k] : lo[k] + n[k] + length - 1])
                start = stop = -1
                for k in mine[alone[mine]].tolist():
                    if lo[k] >= stop:
                        if stop >= 0:
                            out.append(text[start:stop])
                        start = lo[k]
                        shard.append(key), counts.append(0)
                    stop = lo[k] + n[k] + length - 1
                    counts[-1] += 1
                    order.append(k), offsets.append(lo[k] - start)
                if stop >= 0:
                    out.append(text[start:stop])
            chosen = flat.take(pa.array(order, pa.int64()))
            fields = [chosen.field(c) for c in ("gram", "stretch", "n", "weight")] + [pa.array(offsets, pa.int32())]
            pieces = pa.StructArray.from_arrays(fields, ["gram", "stretch", "n", "weight", "at"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pieces)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(out, pa.binary()), lists], ["shard", "bytes", "pieces"])

    return run


def _string_hashes(length: int):
    def run(batches):
        for batch in batches:
            n, data = batch.column(2).to_numpy(), batch.column(4)
            for k in range(batch.num_rows):
                h = _Hasher(np.frombuffer(data[k].as_py(), np.uint8))
                at = np.arange(int(n[k]))
                one, two = h(at, at + length), h(at, at + length // 2) ^ (h(at + length // 2, at + length) * _STEP)
                same = lambda c: batch.column(c).take(pa.array(np.full(len(at), k)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(0), same(1), same(2), same(3), pa.array(at), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["gram", "stretch", "n", "weight", "at", "one", "two"])

    return run


def _dealt(rows: DataFrame, keys: DataFrame, on: list[str], held: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the settled table ``keys``, which has one row a key and in ``held`` how many of ``rows`` it meets.

    Keys that meet over ``HOT_ROWS`` go to every task, and their rows stay where they are; the others are dealt out by key.
    """
    hot = keys.where(F.col(held) > HOT_ROWS).drop(held)
    if hot.isEmpty():
        return rows.join(keys.drop(held), on, how)
    others = rows.join(sized(hot.select(on)), on, "left_anti").join(keys.where(F.col(held) <= HOT_ROWS).drop(held), on, how)
    return others.unionByName(rows.join(sized(hot), on, how))


def repeat_starts(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key``, ``size`` (of a text, see ``text_key``) and ``spans``: where strings of it start that also start elsewhere.

    ``spans`` are ``[from, to)`` of byte places. Texts without such strings, or shorter, are left out.
    """
    texts = docs.select(*text_key(text), F.col(text).cast("string").cast("binary").alias("bytes")).where(F.col("size") >= length)
    schema = "key long, size int, lo long, n int, gram long, stretch long, before long, after long"
    anchors = settle(texts.mapInArrow(_anchored(length), schema), "anchors")
    sides = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("hash")), F.struct(F.lit(1).alias("side"), F.col("after").alias("hash"))), lambda s: s["hash"].isNotNull())
    sided = anchors.select("key", "size", "lo", "n", "gram", "stretch", F.explode(sides).alias("s")).select("key", "size", "lo", "n", "gram", "stretch", "s.side", "s.hash")
    often = settle(sided.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1"), "repeat-hashes")
    # A text that occurs several times gives its anchors as often; they are one row from here on.
    places = (
        _dealt(sided, often, ["hash"], "times", "left_semi")
        .groupBy("key", "size", "lo", "n", "gram", "stretch")
        .agg(F.greatest(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("copies"))
    )
    places = settle(places, "repeat-places")
    stretches = places.groupBy("gram", "stretch", "n").agg(F.sum("copies").alias("weight"), F.min(F.struct("key", "size", "lo")).alias("sample"), F.count("*").alias("held"))
    stretches = settle(stretches, "stretches")
    groups = settle(stretches.groupBy("gram").agg(F.count("*").alias("different"), F.sum(F.col("n") + length - 1).alias("bytes")), "anchor-groups")
    # A stretch that is alone with its anchor and occurs once holds no repeat.
    met = groups.select("gram", "different", F.col("different").alias("rows"))
    sized_up = _dealt(stretches, met, ["gram"], "rows").where("different > 1 or weight > 1")
    takes = sized_up.groupBy("sample.key", "sample.size").agg(
        F.collect_list(F.struct("gram", "stretch", "n", "weight", F.col("sample.lo").alias("lo"), (F.col("different") == 1).alias("alone"))).alias("takes")
    )
    takes = settle(takes, "repeat-takes")
    once = texts.join(sized(takes.select("key", "size")), ["key", "size"], "left_semi").dropDuplicates(["key", "size"])
    runs = once.join(takes, ["key", "size"]).select("key", "bytes", "takes")
    runs = settle(runs.mapInArrow(_cut_out(length), f"shard long, bytes binary, pieces array<{PIECE}>"), "repeat-runs")
    total = runs.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    crowded = sized(groups.where((F.col("bytes") > GROUP_BYTES) & (F.col("different") > 1)).select(F.col("gram").alias("shard")))
    found = "gram long, stretch long, n int, from long, to long"
    few = runs.join(crowded, "shard", "left_anti").withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(shards)))
    by_transform = few.groupBy("part").applyInArrow(_repeated(length), found)
    # Anchors with very many different stretches: their strings are counted by hash, in aggregations that split.
    single = runs.join(crowded, "shard", "left_semi").select("bytes", F.explode("pieces").alias("p"))
    strings = single.select("p.gram", "p.stretch", "p.n", "p.weight", "bytes").mapInArrow(
        _string_hashes(length), "gram long, stretch long, n int, weight long, at long, one long, two long"
    )
    twice = strings.groupBy("gram", "one", "two").agg(F.sum("weight").alias("total"), F.count("*").alias("held")).where("total > 1")
    twice = settle(twice.drop("total"), "repeat-strings")
    by_hash = _dealt(strings, twice, ["gram", "one", "two"], "held").select("gram", "stretch", "n", F.col("at").alias("from"), (F.col("at") + 1).alias("to"))
    spans = by_transform.unionByName(by_hash).groupBy("gram", "stretch", "n").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    hot = sized(stretches.where(F.col("held") > HOT_ROWS).select("gram", "stretch", "n", "held"))
    spans = settle(spans.join(hot, ["gram", "stretch", "n"], "left").withColumn("held", F.coalesce("held", F.lit(0))), "repeat-spans")
    placed = _dealt(places, spans, ["gram", "stretch", "n"], "held").select(
        "key", "size", F.transform("spans", lambda s: F.struct((s["from"] + F.col("lo")).alias("from"), (s["to"] + F.col("lo")).alias("to"))).alias("spans")
    )
    return placed.groupBy("key", "size").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def text_key(text: str) -> list:
    """What names a text: equal texts are one here, different ones differ in it."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(value).alias("key"), F.octet_length(value).alias("size")]


def _removal(length: int):
    def run(batches):
        for batch in batches:
            texts, spans = batch.column(1), batch.column(2)
            kept, begins, stops = [], [], []
            for k in range(batch.num_rows):
                data = np.frombuffer(texts[k].as_py() or b"", np.uint8)
                edge = np.zeros(len(data) + length + 1, np.int64)
                own = spans[k].values
                np.add.at(edge, np.array(own.field("from"), np.int64), 1)
                np.add.at(edge, np.array(own.field("to"), np.int64) + length - 1, -1)
                gone = np.cumsum(edge[: len(data)]) > 0
                steps = np.diff(gone.astype(np.int8), prepend=0, append=0)
                begins.append(np.flatnonzero(steps == 1)), stops.append(np.flatnonzero(steps == -1))
                kept.append(data[~gone].tobytes())
            ends = np.concatenate([[0], np.cumsum([len(b) for b in begins])]).astype(np.int32)
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            removed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([flat(begins), flat(stops)], ["from", "to"]))
            others = [batch.column(c) for c in range(batch.num_columns) if c not in (1, 2)]
            names = [f for c, f in enumerate(batch.schema.names) if c not in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), removed, *others], ["kept", "removed", *names])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with two columns more: ``kept``, the text's bytes without repeats, and ``removed``, the byte spans taken out.

    A byte goes if a string of ``length`` bytes covers it that also starts at another place of any text, this one included,
    as the texts are given; overlaps count, strings never cross texts. Null texts are empty. Equal rows are treated alike, and
    any further columns are passed on (``kept`` and ``removed`` get underscores before them where a column has that name). An
    empty table gives an empty one.
    """
    kept, removed, key, size, data, spans = fresh(docs, "kept", "removed", "key", "size", "data", "spans")
    starts = settle(repeat_starts(docs, text, length), "repeats")
    value = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    k, n = text_key(text)
    keyed = docs.withColumns({key: k, size: n, data: value})
    named = starts.select(F.col("key").alias(key), F.col("size").alias(size), F.col("spans").alias(spans))
    keys = sized(named.select(key, size))
    span = "array<struct<from:bigint,to:bigint>>"
    whole = keyed.join(keys, [key, size], "left_anti").select(*_quoted(docs), F.col(data).alias(kept), F.array().cast(span).alias(removed))
    hit = keyed.join(keys, [key, size], "left_semi").join(named, [key, size])
    cut = hit.select(F.struct(*_quoted(docs)).alias("row"), data, spans)
    cut = cut.mapInArrow(_removal(length), _schema_of(cut.schema["row"], span))
    return whole.union(cut.select("row.*", "kept", "removed"))


def _quoted(docs: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _schema_of(row: StructField, span: str) -> StructType:
    return StructType([StructField("kept", BinaryType()), StructField("removed", StructType.fromDDL(f"x {span}")["x"].dataType), row])
