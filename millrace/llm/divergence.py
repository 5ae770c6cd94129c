"""How far the sources of a language differ in their words, priced from exact joint tables of their counts.

A term's count in a group (a source of a language) is one of the group's levels. Terms are the rows of a matrix of indicator
columns, one for every (group, level), zero included. Its transpose times itself holds, for every two groups, how many terms
have which levels in both: all their joint tables. The product is made of blocks, of terms and of groups, and blocks are summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.cells import col
from millrace.llm.tables import settle, sized

#: A term belongs to the vocabulary of a language in so many documents of it; probabilities are parts of this number.
DOCUMENTS, SCALE = 3, 1_000_000_000
#: Ranks of the terms of a group.
RANKS = 200
#: Groups in a block of columns, columns multiplied at once, and terms in a block: of rare terms, and of frequent ones at least.
GROUPS, COLUMNS, TERMS, FEW_TERMS = 64, 1024, 4096, 256
#: Pairs of group and term a task holds before it hands them on, and bytes of one text split at once.
_HELD, _WINDOW = 400_000, 1 << 22

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part: runs of ASCII letters, in lower case, and of everything beyond ASCII."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + _WINDOW)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches):
    """Of each language and source: terms, their occurrences, and the documents that have them."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (occurrences, documents) in held.items():
            n = len(occurrences)
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(occurrences), pa.binary())]
            counts = [pa.array(list(occurrences.values()), pa.int64()), pa.array([documents[t] for t in occurrences], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + counts, ["lang", "source", "term", "n", "documents"])
        held.clear()

    size = 0
    for batch in batches:
        texts = batch.column(2)
        for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            occurrences, documents = held.setdefault(key, (Counter(), Counter()))
            before, own = len(occurrences), set()
            for part in _terms(texts[k].as_py()):
                occurrences.update(part)
                own.update(part)
            documents.update(own)
            size += len(occurrences) - before
            if size > _HELD:
                yield from rows()
                size = 0
    yield from rows()


class _Indicators:
    """The indicator columns of a block of groups: of every column its ``group`` and ``level``; ``at`` is terms x groups."""

    def __init__(self, first: int, width: int, terms: int, row: np.ndarray, g: np.ndarray, n: np.ndarray):
        inside = (g >= first) & (g < first + width)
        counts = np.zeros((terms, width), np.int64)
        counts[row[inside], g[inside] - first] = n[inside]
        self.at, levels = np.empty((terms, width), np.int64), []
        for k in range(width):
            own, where = np.unique(counts[:, k], return_inverse=True)
            self.at[:, k] = where + sum(map(len, levels))
            levels.append(own)
        self.level = np.concatenate(levels)
        self.group = np.repeat(np.arange(first, first + width), [len(x) for x in levels])

    def columns(self, lo: int, width: int) -> np.ndarray:
        """``width`` columns from ``lo`` on, as zeros and ones. Sums of up to 2**24 of them are exact in this type."""
        out = np.zeros((len(self.at), min(width, len(self.level) - lo)), np.float32)
        term, k = np.nonzero((self.at >= lo) & (self.at < lo + out.shape[1]))
        out[term, self.at[term, k] - lo] = 1
        return out


def _multiplied(size: int, width: int):
    """Joint tables of the groups of two blocks of ``size`` over one block of terms, without terms that both groups lack."""

    def run(table: pa.Table) -> pa.Table:
        lang, left, right, groups = (table.column(c)[0].as_py() for c in ("lang", "left", "right", "groups"))
        entries = table.column("entries").combine_chunks()
        row = np.repeat(np.arange(len(entries)), entries.value_lengths().to_numpy(zero_copy_only=False))
        flat = entries.flatten()
        g, n = flat.field("g").to_numpy().astype(np.int64), flat.field("n").to_numpy()
        side = lambda block: _Indicators(block * size, min(size, groups - block * size), len(entries), row, g, n)
        x = side(left)
        y = x if left == right else side(right)
        found = []
        for lo in range(0, len(x.level), width):
            transposed = x.columns(lo, width).T
            for at in range(lo if x is y else 0, len(y.level), width):
                product = transposed @ y.columns(at, width)
                i, j = np.nonzero(product)
                times = product[i, j].astype(np.int64)
                i, j = i + lo, j + at
                keep = (x.group[i] < y.group[j]) & ((x.level[i] > 0) | (y.level[j] > 0))
                i, j = i[keep], j[keep]
                found.append((x.group[i], y.group[j], x.level[i], y.level[j], times[keep]))
        columns = [np.concatenate(c) for c in zip(*found)]
        types = {"g": pa.int32(), "h": pa.int32(), "a": pa.int64(), "b": pa.int64(), "times": pa.int64()}
        cells = {name: pa.array(c, types[name]) for name, c in zip(types, columns)}
        return pa.table({"lang": pa.array([lang] * len(columns[0]), pa.string())} | cells)

    return run


def _share(count: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))``, in whole numbers of any size."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(18,0)) * CAST({count} + 1 AS DECIMAL(19,0))) div CAST({total} + {terms} AS DECIMAL(20,0))")


def _priced(p: str, q: str) -> Column:
    """``floor((p - q) ** 2 / q)``."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _vocabulary(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms of each language with their counts by group: ``lang``, ``term``, ``total``, ``entries`` (g, n)."""
    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_counted, "lang string, source string, term binary, n long, documents long")
    numbered = counted.join(sized(groups.select("lang", "source", "g")), ["lang", "source"])
    # Tasks have added up their own; dealt by term, all that follows needs no further shuffle.
    dealt = numbered.repartition("lang", "term").groupBy("lang", "term", "g").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = dealt.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.collect_list(F.struct("g", "n")).alias("entries")
    )
    kept = terms.where(F.col("documents") >= DOCUMENTS)
    return kept.select("lang", F.col("term").cast("string").alias("term"), "total", "entries")


def _joint_tables(vocabulary: DataFrame, groups: DataFrame, size: int, width: int, most: int) -> DataFrame:
    """``lang``, ``g`` < ``h``, levels ``a`` and ``b``, not both 0, and at how many terms (``times``) they meet."""
    # Terms of like size share a block: its columns are few, and so are its cells.
    by_size = vocabulary.withColumn("size", F.length(F.bin("total")))
    per_block = F.greatest(F.lit(min(most, FEW_TERMS)), F.expr(f"shiftright({most}, greatest(0, size - 8))"))
    blocks = by_size.groupBy("lang", "size").agg(F.ceil(F.count("*") / per_block).alias("blocks"))
    blocks = blocks.join(groups.groupBy("lang").agg(F.count("*").cast("int").alias("groups")), "lang")
    # Few rows: as many as languages have sizes. A size may hold most of a language, so terms are not dealt by it.
    blocks = sized(settle(blocks, "divergence-blocks"))
    placed = by_size.join(blocks, ["lang", "size"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    last = F.expr(f"(groups - 1) div {size}").cast("int")
    sides = placed.withColumn("left", F.explode(F.sequence(F.lit(0), last))).withColumn("right", F.explode(F.sequence(F.col("left"), last)))
    own = F.filter("entries", lambda e: F.floor(e["g"] / size).isin(F.col("left"), F.col("right")))
    sides = sides.select("lang", "size", "block", "left", "right", "groups", own.alias("entries")).where(F.size("entries") > 0)
    cells = sides.groupBy("lang", "size", "block", "left", "right").applyInArrow(_multiplied(size, width), "lang string, g int, h int, a long, b long, times long")
    return cells.groupBy("lang", "g", "h", "a", "b").agg(F.sum("times").alias("times"))


def divergence(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    group_block: int = GROUPS,
    column_block: int = COLUMNS,
    term_block: int = TERMS,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: how each source of a language differs.

    Terms are maximal runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case; a language keeps those
    that at least ``DOCUMENTS`` of its rows have. A term's share in a group is ``1 + floor(SCALE * (count + 1) / (all counts
    + terms))``. Part ``pair`` has every other source of the language and the sum over its terms of ``floor((p - q) ** 2 /
    q)``, p the group's share and q the other's, 0 without terms; part ``term`` the first ``RANKS`` terms that occur in the
    group with a larger share than in the whole language, by that value with the language's share as q. Larger values come
    first, ties by the item's UTF-8 bytes. All numbers are whole and exact.

    Nulls are empty strings, rows with one id count one by one, texts may be of any length, further columns are not read, and
    an empty table gives an empty one. The sizes of blocks change no result. Whatever share of the rows a group has, tasks add up first and share terms, not groups.
    """
    named = zip((lang, source, text), ("lang", "source", "text"))
    docs = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in named])
    in_order = Window.partitionBy("lang").orderBy("source")
    groups = docs.select("lang", "source").distinct().withColumn("g", F.row_number().over(in_order) - 1)
    groups = settle(groups, "divergence-groups")
    vocabulary = settle(_vocabulary(docs, groups), "divergence-terms")
    entries = vocabulary.select("lang", "term", F.col("total").alias("in_lang"), F.inline("entries"))
    totals = entries.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    terms = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    sums = groups.join(totals, ["lang", "g"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    sums = settle(sums, "divergence-totals")

    cells = _joint_tables(vocabulary, groups, group_block, column_block, term_block)
    ways = F.array(F.struct("g", "h", "a", "b"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("b").alias("a"), F.col("a").alias("b")))
    cells = cells.select("lang", "times", F.inline(ways))
    mine = sums.select("lang", "g", "total", "terms")
    other = sums.select("lang", F.col("g").alias("h"), F.col("total").alias("other_total"))
    priced = cells.join(sized(mine), ["lang", "g"]).join(sized(other), ["lang", "h"])
    priced = priced.withColumns({"p": _share("a", "total", "terms"), "q": _share("b", "other_total", "terms")})
    priced = priced.groupBy("lang", "g", "h").agg(F.sum(F.col("times") * _priced("p", "q")).alias("value"), F.sum("times").alias("met"))
    pairs = sums.select("lang", "source", "g", "total", "terms").join(other.join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]), "lang")
    pairs = pairs.where("g <> h").join(priced, ["lang", "g", "h"], "left").na.fill(0, ["value", "met"])
    # Terms that both groups lack have met in no cell.
    with_terms = F.expr("greatest(terms, 1)")
    pairs = pairs.withColumn("some", with_terms).withColumns({"p": _share("0L", "total", "some"), "q": _share("0L", "other_total", "some")})
    both_lack = (F.col("terms") - F.col("met")) * _priced("p", "q")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + both_lack).alias("value"))

    marked = entries.join(sized(sums), ["lang", "g"])
    marked = marked.withColumns({"p": _share("n", "total", "terms"), "q": _share("in_lang", "lang_total", "terms")}).where("p > q")
    marked = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _priced("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(marked.withColumn("rank", rank).where(F.col("rank") <= RANKS))
