"""Quality rules as a short-circuit cascade: the rule that rejects most per second goes first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import text_slices
from millrace.llm.words import SEPARATOR, SHINGLE, Words, hashed_runs, repeats

SAMPLE_ROWS = 2_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _members(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_SYMBOL, _BANG = _members("#*$%&|<>"), _members("!?")
_UPPER, _LETTER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Measures:
    """Counts over the texts of one slice, each made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._made = data, offsets, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            made = getattr(self, f"_{name}")()
            self._made |= made if isinstance(made, dict) else {name: made}
        return self._made[name]

    def _words(self) -> Words:
        return Words(self.data, self.offsets)

    def _n_words(self) -> np.ndarray:
        return self["words"].count

    def _word_chars(self) -> np.ndarray:
        return _sums(self["words"].inside & ((self.data & 0xC0) != 0x80), self.offsets)

    def _n_symbols(self) -> np.ndarray:
        return _sums(_SYMBOL[self.data], self.offsets)

    def _n_bangs(self) -> np.ndarray:
        return _sums(_BANG[self.data], self.offsets)

    def _n_letters(self) -> np.ndarray:
        return _sums(_LETTER[self.data], self.offsets)

    def _n_upper(self) -> np.ndarray:
        return _sums(_UPPER[self.data], self.offsets)

    def _n_dup_lines(self) -> dict:
        data, offsets = self.data, self.offsets
        filled = offsets[:-1] < offsets[1:]
        breaks = np.flatnonzero(data == 10)
        starts = np.union1d(offsets[:-1][filled], breaks + 1)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        # A line ends before its own break; without one it ends with its text.
        ends = ends - (data[ends - 1] == 10) if len(ends) else ends
        wordy = np.concatenate([[0], np.cumsum(~SEPARATOR[data])])
        has = wordy[ends] > wordy[starts]
        starts, ends = starts[has], ends[has]
        doc = np.searchsorted(offsets, starts, "right") - 1
        _, earlier = repeats(hashed_runs(data, starts, ends), doc)
        n = len(offsets) - 1
        return {"n_dup_lines": np.bincount(doc[earlier], minlength=n), "n_lines": np.bincount(doc, minlength=n)}

    def _n_lines(self) -> dict:
        return self._n_dup_lines()

    def _n_repeat_words(self) -> np.ndarray:
        words = self["words"]
        value, doc, at = words.shingles()
        twice, _ = repeats(value, doc)
        edge = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + SHINGLE, -1)
        return np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=len(self.offsets) - 1)

    def subset(self, rows: np.ndarray) -> Measures:
        """The same texts without those that a rule has rejected; counts made so far are kept."""
        sizes = np.diff(self.offsets)
        keep = np.zeros(len(sizes), bool)
        keep[rows] = True
        out = Measures(self.data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[rows])]))
        out._made = {k: v[rows] for k, v in self._made.items() if k != "words"}
        return out


@dataclass(frozen=True)
class QualityRule:
    """``rejects(measures)`` says which texts go."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


BASE_RULES = (
    QualityRule("few_words", lambda m: m["n_words"] < 10),
    QualityRule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
)
RULES = (
    QualityRule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    # Scripts without spaces have long words by nature, so only mostly Latin texts are judged.
    QualityRule("long_words", lambda m: (m["word_chars"] > 15 * m["n_words"]) & (2 * m["n_letters"] > m["word_chars"])),
    QualityRule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    QualityRule("repeated_lines", lambda m: (m["n_lines"] > 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    QualityRule("shouting", lambda m: (m["n_letters"] > 40) & (10 * m["n_upper"] > 6 * m["n_letters"])),
    QualityRule("exclamations", lambda m: (m["n_words"] > 10) & (2 * m["n_bangs"] > m["n_words"])),
)


def _trial(rules: tuple[QualityRule, ...]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                rows = []
                for rule in rules:
                    began = time.perf_counter()
                    rejected = int(rule.rejects(Measures(data, offsets)).sum())
                    rows.append((rule.name, time.perf_counter() - began, rejected, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["rule", "seconds", "rejected", "seen"])

    return run


def cascade_order(
    docs: DataFrame, rules: tuple[QualityRule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> tuple[QualityRule, ...]:
    """Order rules by rejected texts per second, as measured on a sample of about ``sample_rows`` texts.

    The order changes the work only, never the verdict: a text is kept if no rule rejects it.
    """
    fraction = min(1.0, 2.0 * sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text).cast("string").alias("text")).sample(fraction, seed=7).limit(sample_rows)
    tried = sample.mapInArrow(_trial(rules), "rule string, seconds double, rejected long, seen long")
    sums = tried.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in sums}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def _kept(measures: Measures, rules: tuple[QualityRule, ...], alive: np.ndarray) -> np.ndarray:
    """Which texts pass all rules. Each rule sees only the texts that are ``alive`` after those before it."""
    rows = np.flatnonzero(alive)
    if len(rows) < len(alive):
        measures = measures.subset(rows)
    for rule in rules:
        if not len(rows):
            break
        stays = np.flatnonzero(~rule.rejects(measures))
        if len(stays) < len(rows):
            measures, rows = measures.subset(stays), rows[stays]
    out = np.zeros(len(alive), bool)
    out[rows] = True
    return out


def quality_verdicts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[QualityRule, ...] = RULES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The base counts of every text, whether the base rules reject it, and whether it passes the cascade.

    Returns one row per row of ``docs``: the id, ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` (long),
    ``base_failed`` and ``kept`` (boolean). The cascade runs on texts that the base rules leave, and each of its rules only on
    what earlier ones left. A null text has no words and fails. Ids may be null or repeat; other columns are not read. An
    empty table gives an empty one. Texts count whole, however long; a task holds a slice of them at a time.
    """
    rules = cascade_order(docs, rules, text, sample_rows)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                m = Measures(data, offsets)
                counts = [m[c].astype(np.int64) for c in BASE]
                failed = np.logical_or.reduce([r.rejects(m) for r in BASE_RULES])
                kept = _kept(m, rules, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, (*counts, failed, kept))],
                    ["id", *BASE, "base_failed", "kept"],
                )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)


def keep_quality(docs: DataFrame, text: str = "text", rules: tuple[QualityRule, ...] = BASE_RULES + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text no rule rejects. Nulls, repeats and empty tables as above."""
    rules, schema = cascade_order(docs, rules, text, sample_rows), docs.schema
    place = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(place)):
                kept = _kept(Measures(data, offsets), rules, np.ones(hi - lo, bool))
                if kept.any():
                    yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(run, schema)
