"""Near-duplicate documents by bottom-k sketches: inverted lists, union-sketch estimates, exact similarities."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.tables import fresh, settle, sized, text_slices
from millrace.llm.words import LOWER, Words, mixed

SKETCH = 64
#: Chance that a pair at the threshold shares too few of its sketch values to be found.
MISS = 1e-9
_HALF, _OTHER = np.uint64(1), np.uint64(0x6A09E667F3BCC909)


def least_shared(percent: int) -> int:
    """How many of the ``SKETCH`` least values of the union two linked sets share, but for a chance of ``MISS``."""
    p, tail, shared = percent / 100, 0.0, 0
    while True:
        tail += comb(SKETCH, shared) * p**shared * (1 - p) ** (SKETCH - shared)
        if tail > MISS:
            return shared
        shared += 1


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slice: ``(doc, hash)``, ascending in each text."""
    value, doc, _ = Words(LOWER[data], offsets).shingles(short=True)
    value = value >> _HALF
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], value[new]


def _keys(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and two sums over it that name it: equal sets have equal names."""
    size = np.bincount(doc, minlength=n)
    at, filled = np.cumsum(size) - size, size > 0
    names = []
    for salt in (np.uint64(0), _OTHER):
        out = np.zeros(n, np.uint64)
        if len(value):
            out[filled] = np.add.reduceat(mixed(value ^ salt), at[filled])
        names.append(mixed(out).view(np.int64))
    return size, *names


def _sketches(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            n = hi - lo
            doc, value = _sets(data, offsets)
            size, k1, k2 = _keys(doc, value, n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            least = value[place < SKETCH].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.minimum(size, SKETCH))]).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(size.astype(np.int64)), pa.array(k1), pa.array(k2), sketch],
                ["id", "n", "k1", "k2", "sketch"],
            )


def _full_sets(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(0)):
            doc, value = _sets(data, offsets)
            size, k1, k2 = _keys(doc, value, hi - lo)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), shingles], ["k1", "k2", "shingles"])


def _listed(values: DataFrame, least: Column) -> DataFrame:
    """Inverted lists of the values that a set has to share one of with any set linked to it.

    ``values``: ``value``, ``node``, ``n``. Two linked sets share at least ``least`` of these values, so they share one of the
    ``held - least + 1`` rarest that either holds, ``held`` being its values that occur elsewhere too. Common passages are
    among the others. ``place`` counts a set's values from the rarest, those that occur nowhere else first.
    """
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(shared, "value")
    own = Window.partitionBy("node")
    return (
        held.withColumn("held", F.count("*").over(own))
        .where(F.col("held") >= least)
        .withColumn("order", F.row_number().over(own.orderBy("df", "value")))
        .where(F.col("order") <= F.col("held") - least + 1)
        .select("value", "node", "n", (F.col("n") - F.col("held") + F.col("order")).alias("place"))
    )


def _sizes_fit(percent: int) -> Column:
    """Sets whose sizes differ by more cannot be linked."""
    return F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100


def _sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``n`` and full ``shingles`` of some settled nodes, from the texts of the documents that name them."""
    chosen = sized(nodes.select(F.col("id").alias("end_id")).distinct())
    texts = docs.join(chosen, F.col("id").eqNullSafe(F.col("end_id")), "left_semi").select("text")
    sets = texts.mapInArrow(_full_sets, "k1 long, k2 long, shingles array<long>")
    named = sets.join(sized(nodes.select("node", "n", "k1", "k2")), ["k1", "k2"])
    return settle(named.dropDuplicates(["node"]).select("node", "n", "shingles"), "sets")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the sketch of their union doesn't rule out."""
    sketch = lambda k: nodes.select(F.col("node").alias(k), F.col("sketch").alias(f"sketch_{k}"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), F.col("union")))
    least = F.when(F.size("union") < SKETCH, F.ceil(F.size("union") * percent / 100)).otherwise(least_shared(percent))
    met = pairs.join(sketch("a"), "a").join(sketch("b"), "b").withColumn("union", union)
    return settle(met.where(both >= least).select("a", "b"), "likely-pairs")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets overlap enough."""
    full = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}"))
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    met = pairs.join(full("b"), "b").join(full("a"), "a").withColumn("overlap", overlap)
    total = F.size("set_a") + F.size("set_b") - F.col("overlap")
    return settle(met.where(F.col("overlap") * 100 >= total * percent).select("a", "b"), "links")


def _grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after more settled links. What is known is linked to its roots already, so that this takes few rounds or none."""
    if roots is None:
        return components(links)
    if links.isEmpty():
        return roots
    return components(links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists, with ``root``, whose members are not all in one component yet."""
    placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return placed.join(several.select("value"), "value")


def _spokes(lists: DataFrame, percent: int) -> DataFrame:
    """Every list's members with its hub, the one with the fewest rarer values: nearest to what they have in common."""
    hub = lists.groupBy("value").agg(F.min(F.struct("place", "node", "n")).alias("hub"))
    met = lists.join(hub, "value").where("node != hub.node")
    pairs = met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hub.n").alias("n_a"))
    return settle(pairs.where(_sizes_fit(percent)).select("a", "b").distinct(), "pairs")


def _roots(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` of the components of links between different sets, from enough of these.

    First, each list of sketch values compares its members with one of them, its hub: most groups of copies are one component
    after that, and pairs in one component need no further link. The members of lists that still hold several components
    are then listed by their full sets, which have no sampling error, and compared with the hubs of these lists. What is
    left open meets in pairs: the rarest values are few there, and their places bound how much two sets can share, so sets
    around a common passage or a distant original do not meet.
    """
    values = nodes.select("node", "n", F.explode("sketch").alias("value"))
    lists = settle(_listed(values, F.least(F.lit(least_shared(percent)), F.ceil(F.col("n") * percent / 100))), "lists")
    keys = nodes.select("node", "n", "id", "k1", "k2")
    likely = _likely(_spokes(lists, percent), nodes, percent)
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    roots = _grown(None, _exact(likely, _sets_of(settle(ends.join(keys, "node"), "pair-ends"), docs), percent))

    open_nodes = settle(_mixed(lists, roots).select("node").distinct().join(keys, "node"), "open-nodes")
    if open_nodes.isEmpty():
        return roots
    sets = _sets_of(open_nodes, docs)
    full = settle(_listed(sets.select("node", "n", F.explode("shingles").alias("value")), F.ceil(F.col("n") * percent / 100)), "full-lists")
    near_hubs = _likely(_spokes(settle(_mixed(full, roots).drop("root"), "mixed-lists"), percent), nodes, percent)
    roots = _grown(roots, _exact(near_hubs, sets, percent))
    rows = settle(_mixed(full, roots).select("value", "node", "n", "place", "root"), "open-lists")
    side = lambda k: rows.select("value", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "place", "root")])
    # Sets linked at p share p / (1 + p) of their sizes' sum; what stands before the first shared value is lost to both.
    shared = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    possible = (F.col("n_a") - F.col("place_a") + 1 >= shared) & (F.col("n_b") - F.col("place_b") + 1 >= shared)
    across = side("a").join(side("b"), "value").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & possible)
    rest = settle(across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    return roots if rest.isEmpty() else _grown(roots, _exact(_likely(rest, nodes, percent), sets, percent))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Group documents whose sets of five-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of bytes other than space and ``\\t \\n \\v \\f \\r``, A-Z in lower case. A text of one to four words is one
    shingle; a text without words, or null, is linked with nothing. Shingles are compared by 63-bit hashes.

    Returns per row of ``docs``: the id, ``n_shingles``, ``component_id`` (the smallest id reachable over links, null if none
    has one) and ``kept`` (its id is that one, or none has one). Ids may be null or repeat: equal texts meet as one set, and
    rows with the smallest id are all kept. Other columns are not read, an empty table gives an empty one.

    Equal sets are one node. A node's sketch is the ``SKETCH`` least hashes of its set. Groups of copies are linked through
    hubs, and only sets near the threshold of one another are compared beyond that.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sketches = settle(rows.mapInArrow(_sketches, f"id {kind}, n long, k1 long, k2 long, sketch array<long>"), "sketches")
    nodes = sketches.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = _roots(nodes, rows, percent)
    placed = nodes.select("k1", "k2", "id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = placed.join(smallest, "root").select("k1", "k2", "component_id")
    judged = sketches.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return judged.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (component.isNull() | F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates of a document with a smaller id.

    Every row has a verdict of its own: of a group one row stays, that with the smallest id (of equal ids any), or any if none
    has an id. Texts without words are linked with nothing; of those equal in id and text one stays.
    """
    row, judged = fresh(docs, "row", "judged")
    # Written once, so that a row has the same number wherever it is read.
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(numbered[id].isNull().alias("none"), numbered[id].alias("id"), F.col(row).alias("row"))
    keyed = numbered.select(key.alias("key"), numbered[text].cast("string").alias("text"))
    verdicts = settle(near_duplicates(keyed, "key", "text", percent).select("key.row", "n_shingles", "kept"), "verdicts")
    gone = verdicts.where("not kept").select("row")
    # Wordless texts are told apart by their fingerprints; the first row of each stays.
    bare = keyed.join(sized(verdicts.where("n_shingles = 0").select("row")), F.col("key.row") == F.col("row"), "left_semi")
    alike = bare.groupBy(F.col("key.id").alias("id"), F.md5("text").alias("print")).agg(F.min("key.row").alias("row"))
    bare = bare.select(F.col("key.row").alias("row")).join(settle(alike.select("row"), "wordless"), "row", "left_anti")
    gone = settle(gone.union(bare).select(F.col("row").alias(judged)), "gone")
    return numbered.join(sized(gone), F.col(row) == F.col(judged), "left_anti").select([numbered[c] for c in docs.columns])
