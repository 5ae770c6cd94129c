"""A toxicity classifier whose scores are kept from depending on which group a text mentions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import text_slices
from millrace.llm.words import Words, hashed_runs, mixed

#: Labelled rows the classifier is fitted on: all up to this number, else a sample of about as many.
SAMPLE_ROWS = 12_000
#: Features that can get a weight: those most unevenly spread over the two labels.
FEATURES = 6_000
PAIRING = 5.0
SPARSITY = 1e-4
STEPS = 400
PREFIXES = (3, 4, 5, 6)

#: Fixed lists: terms of one line name groups of one kind, so that any may stand for another.
IDENTITY_TERMS = """
man woman person boy girl male female trans transgender nonbinary
gay lesbian straight bisexual queer heterosexual homosexual
muslim christian jewish hindu buddhist sikh atheist catholic protestant
muslims christians jews hindus buddhists sikhs atheists catholics protestants
black white asian latino hispanic african european arab indigenous
german french spanish american mexican chinese indian russian turkish polish
deaf blind disabled autistic
young old elderly
mann frau junge
homme femme garçon fille
hombre mujer chico chica
musulman chrétien juif bouddhiste
musulmán cristiano judío budista
muslimisch christlich jüdisch buddhistisch
""".strip()

_WORD_BYTE = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100), 0x27]:
    _WORD_BYTE[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD_BYTE[_b] = _b + 32


def _swaps() -> dict[str, str]:
    """Each term and the next one of its line."""
    lines = [line.split() for line in IDENTITY_TERMS.splitlines()]
    return {a: b for line in lines for a, b in zip(line, line[1:] + line[:1])}


def _features_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word, feature)``: each word itself, and its first bytes, which compounds and inflected forms share."""
    word, feature = [np.arange(len(starts))], [hashed_runs(data, starts, ends)]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts >= size)
        word.append(long)
        feature.append(mixed(hashed_runs(data, starts[long], starts[long] + size) + np.uint64(size)))
    return np.concatenate(word), np.concatenate(feature)


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


class _Slice:
    """Words of a slice of texts, each different one once, and which text has which."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _WORD_BYTE[data]
        words = Words(self.data, offsets)
        self.hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.starts, self.ends = words.starts[first], words.ends[first]
        self.doc, self.which, self.docs = words.doc, which.reshape(-1), len(offsets) - 1


def _packed(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(t) for t in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(t) for t in raw], ends


class _Sample:
    """Sparse rows of the labelled texts, and of each text with identity terms its counterfactual."""

    def __init__(self):
        self.row, self.feature, self.label = [], [], []
        self.swapped_row, self.swapped_feature, self.rows = [], [], 0
        swaps = _swaps()
        data, starts, ends = _packed(list(swaps))
        self.term = hashed_runs(data, starts, ends)
        self.partner = _packed(list(swaps.values()))

    def add(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> None:
        s = _Slice(data, offsets)
        doc, which = _distinct(s.doc, s.which)
        word, feature = _features_of(s.data, s.starts, s.ends)
        self._collect(self.row, self.feature, doc, which, word, feature)
        order = np.argsort(self.term)
        place = np.minimum(np.searchsorted(self.term[order], s.hashes), len(order) - 1)
        is_term = self.term[order][place] == s.hashes
        named = np.zeros(s.docs, bool)
        named[doc[is_term[which]]] = True
        if named.any():
            own = named[doc]
            doc, which = doc[own], which[own]
            plain = ~is_term[which]
            self._collect(self.swapped_row, self.swapped_feature, doc[plain], which[plain], word, feature)
            word, feature = _features_of(*self.partner)
            self._collect(self.swapped_row, self.swapped_feature, doc[~plain], order[place[which[~plain]]], word, feature)
        self.label.append(label)
        self.rows += s.docs

    def _collect(self, rows: list, features: list, doc, which, word, feature) -> None:
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=int(which.max(initial=-1)) + 1)
        first = np.cumsum(counts) - counts
        many = counts[which]
        at = np.repeat(first[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        row, value = _distinct(np.repeat(doc, many), feature[order[at]])
        rows.append((row + self.rows).astype(np.int32))
        features.append(value)

    def fitted(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Feature hashes (ascending), their weights and the constant."""
        label = np.concatenate([*self.label, np.zeros(0)])
        n, toxic = len(label), float(label.sum())
        if not 0 < toxic < n:
            return np.zeros(0, np.uint64), np.zeros(0), 4.0 if toxic else -4.0
        row, feature = np.concatenate(self.row), np.concatenate(self.feature)
        coarse = np.bincount((feature & np.uint64(0x3FFFFF)).astype(np.int64), minlength=1 << 22)
        often = coarse[(feature & np.uint64(0x3FFFFF)).astype(np.int64)] >= 3
        row, feature = row[often], feature[often]
        names, column = np.unique(feature, return_inverse=True)
        column = column.reshape(-1)
        seen = np.bincount(column, minlength=len(names)).astype(float)
        hits = np.bincount(column, label[row], minlength=len(names))
        # How far the share of toxic texts with the feature is from the share without it, in standard errors.
        rate = (hits + 0.5 * toxic / n) / (seen + 0.5)
        spread = np.abs(rate - toxic / n) * np.sqrt(seen)
        best = np.sort(np.argsort(-spread, kind="stable")[:FEATURES])
        place = np.full(len(names), -1)
        place[best] = np.arange(len(best))
        own = place[column] >= 0
        row, column, names = row[own], place[column[own]], names[best]
        pair_row, pair_column, pair_sign, pairs = self._pairs(row, column, names)
        return names, *_descend(label, row, column, len(names), pair_row, pair_column, pair_sign, pairs)

    def _pairs(self, row, column, names):
        """Texts with identity terms less their counterfactuals, as one sparse matrix of differences."""
        if not self.swapped_row:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 1
        there, feature = np.concatenate(self.swapped_row), np.concatenate(self.swapped_feature)
        place = np.minimum(np.searchsorted(names, feature), len(names) - 1)
        known = names[place] == feature
        named = np.unique(there)
        number = np.full(self.rows, -1)
        number[named] = np.arange(len(named))
        own = number[row] >= 0
        rows = np.concatenate([number[row[own]], number[there[known]]])
        columns = np.concatenate([column[own], place[known]])
        return rows, columns, np.concatenate([np.ones(int(own.sum())), -np.ones(int(known.sum()))]), len(named)


def _descend(label, row, column, width, pair_row, pair_column, pair_sign, pairs):
    """Logistic loss, plus ``PAIRING`` times the mean squared score change between counterfactuals, plus sparsity."""
    n, w = len(label), np.zeros(width)
    share = label.mean()
    b = float(np.log(share / (1 - share)))
    memory, memory_b, kept, kept_b = np.zeros(width), 0.0, np.zeros(width), 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[column], minlength=n), -30, 30)))
        error = (p - label) / n
        slope = np.bincount(column, error[row], minlength=width)
        if len(pair_row):
            change = np.bincount(pair_row, pair_sign * w[pair_column], minlength=pairs) * (2 * PAIRING / pairs)
            slope += np.bincount(pair_column, pair_sign * change[pair_row], minlength=width)
        slope_b = float(error.sum())
        memory, memory_b = 0.9 * memory + 0.1 * slope, 0.9 * memory_b + 0.1 * slope_b
        kept, kept_b = 0.99 * kept + 0.01 * slope**2, 0.99 * kept_b + 0.01 * slope_b**2
        rate = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        scale = rate / (np.sqrt(kept) + 1e-6)
        w = w - scale * memory
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale, 1e3) * SPARSITY, 0)
        b -= rate * memory_b / (kept_b**0.5 + 1e-6)
    return w, b


def _fit(batches):
    sample = _Sample()
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(0)):
            sample.add(data, offsets, batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(float))
    names, w, b = sample.fitted()
    used = w != 0
    names, w = names[used].view(np.int64), w[used]
    yield pa.RecordBatch.from_arrays([pa.array([names.tolist()], pa.list_(pa.int64())), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([b])], ["names", "weights", "constant"])


def _score(names: np.ndarray, weights: np.ndarray, constant: float):
    order = np.argsort(names)
    names, weights = names[order], weights[order]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                s = _Slice(data, offsets)
                z = np.full(s.docs, constant)
                if len(names) and len(s.doc):
                    word, feature = _features_of(s.data, s.starts, s.ends)
                    place = np.minimum(np.searchsorted(names, feature), len(names) - 1)
                    hit = names[place] == feature
                    word, place = word[hit], place[hit]
                    marked = np.zeros(len(s.hashes), bool)
                    marked[word] = True
                    doc, which = _distinct(s.doc[marked[s.which]], s.which[marked[s.which]])
                    order = np.argsort(word, kind="stable")
                    counts = np.bincount(word, minlength=len(s.hashes))
                    first, many = np.cumsum(counts) - counts, counts[which]
                    at = np.repeat(first[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    doc, place = _distinct(np.repeat(doc, many), place[order[at]])
                    z += np.bincount(doc, weights[place], minlength=s.docs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Fit on the labelled texts and score every whole text: the id and ``score``, from 0 to 1.

    ``labels`` has the id and ``label`` (0 or 1); rows with a null in either are ignored, and 1 wins where an id has both. Up
    to ``sample_rows`` labelled ids, or a sample of about as many spread by hash, are fitted in one task; scoring is
    distributed. Features are a text's words in lower case and their first bytes; nothing but the text goes into a score.

    In training, each labelled text that names a group is paired with itself naming another group of the same kind, and
    score changes between the two are penalised, so that a mention alone moves a score little.

    Each row of ``docs`` gives one row: a null text is empty and scored as such, ids may be null or repeat, other columns are
    not read, an empty table gives an empty one. Without labelled texts, or if none is toxic, all scores are near 0; near 1 if
    all are.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    fitted = rows.join(F.broadcast(known), "id").select("text", "label").repartition(1)
    model = fitted.mapInArrow(_fit, "names array<long>, weights array<double>, constant double").first()
    model = model or {"names": [], "weights": [], "constant": -4.0}
    names, weights = np.array(model["names"], np.int64).view(np.uint64), np.array(model["weights"], float)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double"
    return rows.mapInArrow(_score(names, weights, model["constant"]), schema).withColumnRenamed("id", id)
