"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph in every shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import settle

#: Distinct vectors in a shard, and queries that meet a shard at once: what a task holds.
SHARD_ROWS, BLOCK_QUERIES = 4_000, 1_024
DEGREE, SLACK = 40, 16
BUILD_BEAM, SEARCH_BEAM = 96, 256
RELAX = 1.2
_STEP_ROWS = 256


class Graph:
    """Vectors and their edges. Largest inner product is turned into least distance by one more coordinate,

    ``sqrt(reach**2 - |x|**2)``, which queries have as 0. ``reach``: the largest norm of all vectors of the table.
    """

    def __init__(self, vectors: np.ndarray, reach: float, edges: np.ndarray | None = None):
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        extra = np.sqrt(np.maximum(reach * reach - norms, 0.0))
        self.points = np.column_stack([vectors, extra]).astype(np.float32)
        self.half = (self.points.astype(np.float64) ** 2).sum(1).astype(np.float32) / 2
        self.n = len(vectors)
        self.entry = int(np.argmin(((self.points - self.points.mean(0)) ** 2).sum(1)))
        self.edges = np.full((self.n, DEGREE + SLACK), -1, np.int32) if edges is None else edges

    def search(self, queries: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: ids (-1: none) and keys (less is nearer), ascending.

        Each step expands the ``width`` nearest open points of every beam, until all points of the beam are expanded.
        """
        m = len(queries)
        ids = np.full((m, beam), -1, np.int64)
        keys = np.full((m, beam), np.inf, np.float32)
        closed = np.ones((m, beam), bool)
        seen = np.zeros((m, self.n + 1), bool)
        ids[:, 0], closed[:, 0], seen[:, self.entry] = self.entry, False, True
        seen[:, -1] = True
        keys[:, 0] = self.half[self.entry] - queries @ self.points[self.entry]
        active = np.arange(m)
        while len(active):
            open_first = np.argsort(closed[active], axis=1, kind="stable")[:, :width]
            row = active[:, None]
            chosen = np.where(closed[row, open_first], -1, ids[row, open_first])
            closed[row, open_first] = True
            near = self.edges[chosen]
            near[chosen < 0] = -1
            near = near.reshape(len(active), -1).astype(np.int64)
            near[seen[row, near]] = -1
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[row, near] = True
            fresh = np.flatnonzero((near >= 0).any(0))
            near = near[:, fresh]
            if near.shape[1]:
                key = self.half[near] - np.matmul(self.points[near], queries[active][:, :, None])[:, :, 0]
                key[near < 0] = np.inf
                all_keys = np.concatenate([keys[active], key], 1)
                all_ids = np.concatenate([ids[active], near], 1)
                all_closed = np.concatenate([closed[active], near < 0], 1)
                best = np.argsort(all_keys, axis=1, kind="stable")[:, :beam]
                pick = np.arange(len(active))[:, None]
                keys[active], ids[active], closed[active] = all_keys[pick, best], all_ids[pick, best], all_closed[pick, best]
            active = active[~closed[active].all(1)]
        return ids, keys

    def pruned(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest candidate stays and takes away those much nearer to it than to the point, and so on."""
        center = self.points[points]
        bad = (candidates < 0) | (candidates == points[:, None])
        vectors = self.points[candidates]
        away = ((vectors - center[:, None, :]) ** 2).sum(2)
        away[bad] = np.inf
        out = np.full((len(points), DEGREE + SLACK), -1, np.int32)
        open_away = away.copy()
        rows = np.arange(len(points))
        for k in range(DEGREE):
            nearest = open_away.argmin(1)
            there = np.isfinite(open_away[rows, nearest])
            if not there.any():
                break
            out[there, k] = candidates[rows, nearest][there]
            chosen = vectors[rows, nearest]
            between = ((vectors - chosen[:, None, :]) ** 2).sum(2)
            open_away[(RELAX * RELAX * between <= away) | (candidates == candidates[rows, nearest][:, None])] = np.inf
        return out

    def _link(self, points: np.ndarray) -> None:
        """Insert points: greedy searches propose neighbours, pruning chooses, chosen ones get an edge back."""
        for lo in range(0, len(points), _STEP_ROWS):
            some = points[lo : lo + _STEP_ROWS]
            found, _ = self.search(self.points[some], BUILD_BEAM, 4)
            self.edges[some] = self.pruned(some, np.concatenate([found, self.edges[some]], 1))
        source = np.repeat(points, DEGREE + SLACK)
        target = self.edges[points].reshape(-1).astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        degree = (self.edges[nodes] >= 0).sum(1)
        # Edges of a node stand at its front, so that free places follow.
        room = degree + counts <= DEGREE + SLACK
        place = np.arange(len(target)) - np.repeat(first, counts) + np.repeat(degree, counts)
        simple = np.repeat(room, counts)
        self.edges[target[simple], place[simple]] = source[simple]
        full = np.flatnonzero(~room)
        for lo in range(0, len(full), _STEP_ROWS):
            some = full[lo : lo + _STEP_ROWS]
            most = int(counts[some].max())
            back = np.full((len(some), most), -1, np.int64)
            for k, j in enumerate(some):
                back[k, : counts[j]] = source[first[j] : first[j] + counts[j]]
            self.edges[nodes[some]] = self.pruned(nodes[some], np.concatenate([self.edges[nodes[some]], back], 1))

    def build(self) -> Graph:
        order = np.random.default_rng(11).permutation(self.n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        at, size = 1, 1
        while at < self.n:
            self._link(order[at : at + size])
            at += size
            size = min(2 * size, max(64, self.n // 50))
        return self


def _built(reach: float):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        vectors = np.array(table.column("vector").combine_chunks().flatten(), np.float32).reshape(-1, dim)
        ids = table.column("ids").combine_chunks()
        copies = ids.flatten()
        graph = Graph(vectors, reach).build()
        blob = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
        return pa.table(
            {
                "dim": table.column("dim").slice(0, 1),
                "shard": table.column("shard").slice(0, 1),
                "ids": blob(copies.field("id"), np.int64),
                "rows": blob(copies.field("row"), np.int64),
                "counts": blob(ids.value_lengths(), np.int64),
                "vectors": blob(vectors, np.float32),
                "edges": blob(graph.edges, np.int32),
            }
        )

    return run


def _searched(k: int, reach: float, beam: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                at = lambda name: batch.column(name)[r]  # noqa: B023, E731
                dim = at("dim").as_py()
                vectors = np.frombuffer(at("vectors").as_py(), np.float32).reshape(-1, dim)
                edges = np.frombuffer(at("edges").as_py(), np.int32).reshape(len(vectors), -1)
                graph = Graph(vectors, reach, edges)
                ids, rows, counts = (np.frombuffer(at(c).as_py(), np.int64) for c in ("ids", "rows", "counts"))
                first = np.cumsum(counts) - counts
                asked = at("queries").values
                who, own = (np.array(asked.field(c), np.int64) for c in ("id", "row"))
                queries = np.array(asked.field("vector").flatten(), np.float32).reshape(-1, dim)
                for lo in range(0, len(who), _STEP_ROWS):
                    q = queries[lo : lo + _STEP_ROWS]
                    found, _ = graph.search(np.column_stack([q, np.zeros(len(q), np.float32)]), beam, 8)
                    found = found[:, : k + 1]
                    score = (vectors[found].astype(np.float64) * q[:, None, :].astype(np.float64)).sum(2)
                    row, column = np.nonzero(found >= 0)
                    hit = found[row, column]
                    # Every copy of a vector found is a neighbour, as far as it may be among the k nearest.
                    many = counts[hit]
                    back = np.repeat(np.arange(len(hit)), many)
                    copy = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(who[lo : lo + _STEP_ROWS][row[back]]),
                            pa.array(own[lo : lo + _STEP_ROWS][row[back]]),
                            pa.array(ids[first[hit[back]] + copy]),
                            pa.array(rows[first[hit[back]] + copy]),
                            pa.array(score[row[back], column[back]]),
                        ],
                        ["query_id", "query_row", "vec_id", "row", "score"],
                    )

    return run


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_vectors(
    table: DataFrame,
    queries: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    beam: int = SEARCH_BEAM,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` rows of ``table`` found nearest to each of its rows that satisfy ``queries``, by largest inner product.

    Returns ``query_id``, ``rank`` (from 1; ties go to the smaller id), ``vec_id`` and ``score``, the inner product in double
    precision of the vectors as given. Rows without an id, and vectors that are null, zero or hold a null or non-finite
    component, take no part. A vector meets vectors of its own dimension only. Rows that share an id are queries and candidates
    of their own. Fewer than ``k`` others give fewer rows, an empty table none. Other columns serve ``queries`` only.

    All rows are indexed: equal vectors once (with as many of their rows as can matter), spread by hash over shards of
    about ``shard_rows``, each with a graph of its own. Queries meet every shard in blocks, so a task holds one shard and one
    block whatever the size of the table.
    """
    rows = (
        table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"), queries.alias("asks"))
        .where(F.col("id").isNotNull() & _usable(F.col("vector")))
        .withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()})
    )
    # Ids may repeat: from here on a row is named by its number.
    rows = settle(rows, "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("reach"), F.sum(F.col("asks").cast("long")).alias("q")).collect()
    reach = max([r["reach"] for r in sizes], default=1.0)
    counts = rows.sparkSession.createDataFrame(
        [(r["dim"], -(-r["n"] // shard_rows), -(-(r["q"] or 0) // BLOCK_QUERIES)) for r in sizes], "dim int, shards long, blocks long"
    )
    # Per distinct vector its k + 1 rows of smallest ids: a copy beyond them is never among the k nearest.
    smallest = Window.partitionBy("vector").orderBy("id", "row")
    distinct = (
        rows.withColumn("place", F.row_number().over(smallest))
        .where(F.col("place") <= k + 1)
        .groupBy("dim", "vector")
        .agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("ids"))
        .join(F.broadcast(counts), "dim")
        .select("dim", F.pmod(F.xxhash64("vector"), "shards").alias("shard"), "ids", "vector")
    )
    index = settle(
        distinct.groupBy("dim", "shard").applyInArrow(
            _built(reach), "dim int, shard long, ids binary, rows binary, counts binary, vectors binary, edges binary"
        ),
        "vector-graphs",
    )
    blocks = (
        rows.where("asks")
        .join(F.broadcast(counts), "dim")
        .groupBy("dim", "shards", F.pmod(F.xxhash64("row"), "blocks").alias("block"))
        .agg(F.collect_list(F.struct("id", "row", "vector")).alias("queries"))
        .select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "queries")
    )
    pairs = index.join(blocks, ["dim", "shard"]).select("dim", "ids", "rows", "counts", "vectors", "edges", "queries")
    pairs = pairs.repartition(max(1, min(4096, sum(-(-r["n"] // shard_rows) * -(-(r["q"] or 0) // BLOCK_QUERIES) for r in sizes))))
    found = pairs.mapInArrow(_searched(k, reach, beam), "query_id long, query_row long, vec_id long, row long, score double").where("query_row != row")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
