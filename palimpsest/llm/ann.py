"""Nearest neighbours by a forest of random-projection trees with a shared priority queue, then exact distances.

The trees are fitted on a bounded sample and are the same size whatever the table: each node is a random direction
and the median of its sample's projections. Every vector is in a leaf of every tree. A query goes down
all trees at once with one priority queue of branches not taken, nearest cells first, until the leaves it has
reached hold its share of the sample; then all vectors in those leaves are candidates, and their exact
distances decide. The share is what the sample's own neighbours need for the recall that is asked for.

Rows and queries meet by leaf: a row goes to its leaf of each tree, a query to the leaves it reaches, and only these pairs are
computed. Leaves of many rows or queries are dealt into blocks of bounded size, every block of rows meeting every block of
queries of its leaf. Of equal vectors only those with the smallest ids go on, as no others can be among the
nearest: a vector that a third of all rows have is a few rows. The driver holds the forest and a count for each leaf.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Stash, table

SAMPLE, TREES, LEAF = 4096, 3, 16
#: Sampled queries whose neighbours tell the share, and the part of them that must be found.
PROBES, RECALL = 256, 0.96
#: Rows and queries of a leaf that one task may hold together: 8 and 4 MB with 64 components.
ROWS, QUERIES = 16_384, 8192


class Tree:
    """Complete binary tree of `depth` levels: directions and medians by node, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        inner = (1 << depth) - 1
        self.directions = rng.standard_normal((inner, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.medians = np.zeros(inner)
        at = np.zeros(len(sample), dtype=np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            if len(own):
                p = sample[own] @ self.directions[node]
                self.medians[node] = np.median(p)
                at[own] = 2 * node + 1 + (p > self.medians[node])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, from 0."""
        side = rows @ self.directions.T > self.medians
        at, each = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            at = 2 * at + 1 + side[each, at]
        return at - ((1 << self.depth) - 1)


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 3):
        depth = max(0, int(np.ceil(np.log2(max(len(sample), 1) / leaf))))
        rng = np.random.default_rng(seed)
        self.sample, self.width = sample, 1 << depth
        self.trees = [Tree(sample, depth, rng) for _ in range(trees)]
        own = [t.leaves(sample) if len(sample) else np.zeros(0, np.int64) for t in self.trees]
        self.members = [[np.flatnonzero(row == k) for k in range(self.width)] for row in own]
        self.n = len(sample)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through all trees: (trees, rows)."""
        return np.stack([t.leaves(rows) + k * self.width for k, t in enumerate(self.trees)])

    def walk(self, query: np.ndarray):
        """The leaves in the order in which a query reaches them, by the sum of squares of what it lies beyond of the
        hyperplanes on the way."""
        margins = [t.directions @ query - t.medians for t in self.trees]
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        while queue:
            far, t, node = heapq.heappop(queue)
            while node < len(margins[t]):
                m = margins[t][node]
                heapq.heappush(queue, (far + m * m, t, 2 * node + 1 + (m <= 0)))
                node = 2 * node + 1 + (m > 0)
            yield t * self.width + node - len(margins[t])

    def own(self, leaf: int) -> np.ndarray:
        return self.members[leaf // self.width][leaf % self.width]

    def visit(self, query: np.ndarray, least: float) -> list[int]:
        """The leaves that a query reaches until they hold `least` of the sample, or all of it."""
        seen, held, out = np.zeros(self.n, dtype=bool), 0, []
        for leaf in self.walk(query):
            if held >= min(least, self.n):
                break
            out.append(leaf)
            own = self.own(leaf)
            held += int((~seen[own]).sum())
            seen[own] = True
        return out

    def share_for(self, recall: float, k: int, probes: int = PROBES) -> float:
        """The share of the sample that must be held for this part of the k nearest in the sample, over `probes` of its vectors. In a
        larger table neighbours are nearer, and more of them are found."""
        needed = []
        for i in np.linspace(0, self.n - 1, min(probes, self.n)).astype(int):
            d = ((self.sample - self.sample[i]) ** 2).sum(1)
            d[i] = np.inf
            nearest = np.argsort(d, kind="stable")[: min(k, self.n - 1)]
            held = np.zeros(self.n, dtype=np.int64)  # how much is held when each is first seen
            total = 0
            for leaf in self.walk(self.sample[i]):
                own = self.own(leaf)
                new = own[held[own] == 0]
                total += len(new)
                held[new] = total
                if (held[nearest] > 0).all():
                    break
            needed.append(held[nearest])
        needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
        return float(needed[int(np.ceil(recall * len(needed))) - 1]) / self.n if len(needed) else 1.0


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_in(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of the k nearest rows of each query in double precision, ties to smaller ids, a query's own id left out."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    norm, q_norm = (x * x).sum(1), (q * q).sum(1)
    for s in range(0, len(q), 256):
        part, own, parts = q[s : s + 256], q_norm[s : s + 256], []
        for at in range(0, len(x), 2048):
            rows = slice(at, at + 2048)
            d = own[:, None] + norm[None, rows] - 2 * (part @ x[rows].T)
            d[q_ids[s : s + 256, None] == ids[None, rows]] = np.inf
            top = min(k, d.shape[1]) - 1
            last = np.partition(d, top, axis=1)[:, top]
            # by products first; those that rounding could put among the best get their exact distance
            edge = np.where(np.isfinite(last), last + 1e-9 * (1 + own + norm[rows].max()), np.finfo(float).max)
            i, j = np.nonzero(d <= edge[:, None])
            parts.append((i + s, j + at, np.sqrt(((part[i] - x[rows][j]) ** 2).sum(1))))
        i, j, exact = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        by = np.lexsort((ids[j], exact, i))
        i, j, exact = i[by], j[by], exact[by]
        good = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((q_ids[i[good]], ids[j[good]], exact[good]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v) of rows that take part: id not null; vector not null, empty or zero, all components finite numbers, of the
    most frequent number of components (the smallest such). Vectors of floats stay such, as they are doubles in half the room."""
    kind = rows.schema[vector_col].dataType.simpleString()
    v = F.col(f"`{vector_col}`").cast(kind if kind == "array<float>" else "array<double>")
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("_id"), v.alias("_v")).where("_id is not null and _v is not null and size(_v) > 0")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    out = out.where(F.forall("_v", fine) & F.exists("_v", lambda x: x != 0))
    sizes = out.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return out.where(F.size("_v") == (sizes[0]["d"] if sizes else 0))


class Search:
    """A search in the making: rows and queries with their leaves, and how many of each a leaf has."""

    def __init__(self, rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, share: float | None, recall: float, forest: Forest | None):
        self.spark, self.k, self.forest, self.share = rows.sparkSession, k, forest, share
        good = valid_vectors(rows, id_col, vector_col).distinct()
        alike = Window.partitionBy("_v").orderBy("_id")
        self.rows = Stash(good.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).drop("_r"), "vectors").df
        dims = self.rows.select(F.size("_v").alias("d")).limit(1).collect()
        self.n = self.rows.count() if dims else 0
        self.row_counts = self.query_counts = np.zeros(0, np.int64)
        if not dims:
            return
        if self.forest is None:
            sample = self.rows.orderBy(F.xxhash64("_v"), "_id").limit(SAMPLE).select("_v").toArrow()
            self.forest = Forest(_matrix(sample.column("_v")))
        forest = self.forest
        if self.share is None:
            self.share = forest.share_for(recall, k)
        want, leaves = max(self.share, (k + 1) / self.n) * forest.n, len(forest.trees) * forest.width

        def visit(batches):
            for batch in batches:
                if batch.num_rows:
                    reached = [forest.visit(q, want) for q in _matrix(batch.column("_v"))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached, pa.list_(pa.int32()))], ["_id", "_v", "leaves"])

        def count(batches):
            total = np.zeros(leaves, np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += np.bincount(forest.leaves(_matrix(batch.column("_v"))).ravel(), minlength=leaves)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(leaves, dtype=np.int32)), pa.array(total)], ["leaf", "n"])

        asked = valid_vectors(queries, id_col, vector_col).where(F.size("_v") == dims[0]["d"]).distinct()
        self.queries = Stash(asked.mapInArrow(visit, f"_id long, _v {asked.schema['_v'].dataType.simpleString()}, leaves array<int>"), "queries").df
        self.row_counts, self.query_counts = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        for r in self.rows.mapInArrow(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
            self.row_counts[r["leaf"]] = r["n"]
        for r in self.queries.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect():
            self.query_counts[r["leaf"]] = r["n"]

    def products(self) -> int:
        """Distances that are computed, those that meet in leaves of several trees as often; all pairs would be rows times queries."""
        return int((self.row_counts * self.query_counts).sum())

    def run(self) -> DataFrame:
        if not self.products():
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        forest, k = self.forest, self.k
        across, down = -(-self.row_counts // ROWS), -(-self.query_counts // QUERIES)  # blocks of rows and of queries of each leaf
        reached = self.query_counts > 0
        kind = self.rows.schema["_v"].dataType.simpleString()

        def deal(batches):
            for batch in batches:
                if batch.num_rows:
                    leaf = forest.leaves(_matrix(batch.column("_v")))
                    at = np.tile(np.arange(batch.num_rows), len(leaf))
                    leaf = leaf.ravel()
                    at, leaf = at[reached[leaf]], leaf[reached[leaf]]
                    block = (batch.column("_id").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % across[leaf]
                    times = down[leaf]
                    at, leaf, block = np.repeat(at, times), np.repeat(leaf, times), np.repeat(block, times)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    for s in range(0, len(at), 10_000):
                        own = slice(s, s + 10_000)
                        take = pa.array(at[own])
                        keys = [pa.array(x[own].astype(np.int32)) for x in (leaf, block, other)]
                        yield pa.RecordBatch.from_arrays([*keys, batch.column("_id").take(take), batch.column("_v").take(take)], ["leaf", "b", "qb", "_id", "_v"])

        rows = self.rows.mapInArrow(deal, f"leaf int, b int, qb int, _id long, _v {kind}")
        of = lambda counts: F.element_at(F.array(*(F.lit(int(max(x, 1))) for x in counts)), F.col("leaf") + 1)
        queries = self.queries.select("_id", "_v", F.explode("leaves").alias("leaf")).select("leaf", F.pmod(F.xxhash64("_id"), of(down)).cast("int").alias("qb"), "_id", "_v", of(across).alias("across"))
        queries = queries.select("leaf", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("b"), "qb", "_id", "_v")

        def meet(x: pa.Table, q: pa.Table) -> pa.Table:
            out = nearest_in(q.column("_id").to_numpy(), _matrix(q.column("_v")), x.column("_id").to_numpy(), _matrix(x.column("_v")), k) if x.num_rows and q.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

        keys = ("leaf", "b", "qb")
        found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
        # a row that meets a query in several leaves has one rank
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()


def nearest(
    rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, share: float | None = None, recall: float = RECALL, forest: Forest | None = None,
) -> DataFrame:
    """query_id (long), rank (int, from 1), vec_id (long), score (double): for each query its k nearest candidates found, by
    Euclidean distance in double precision, ties to smaller ids; a row with the query's id is no candidate.

    A query looks at the leaves that hold `share` of the sample, at tables of every size, and the part that k + 1 rows make up at least. Without a
    share it is the one by which the sample's vectors find `recall` of their own k nearest: most of all rows where vectors have no structure, a
    small part where they have.

    Null ids and vectors that are null, empty, zero, of another length than most or with a component that is null or not
    finite: take no part. Repeated rows: an id and vector count once; of several vectors of an id, each is one.
    Very long vectors: as others. Fewer than k candidates: all. Empty tables: empty result. Other columns are not read.
    """
    return Search(rows, queries, id_col, vector_col, k, share, recall, forest).run()


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
