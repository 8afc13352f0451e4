"""Recall: exact search over vectors, hybrid ranking, per-session caps and token budgets, and re-ranking for diversity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.operators import cluster
from palimpsest.plans.materialize import stash

FLOOR, PER_SESSION = 0.18, 2


def search(vectors: DataFrame, query, limit: int = 10, project: str | None = None, id_col: str = "chunk_id") -> DataFrame:
    """The rows nearest to query by dot product of normalised vectors, with a score; ties to smaller ids. The order and limit
    are one step, of which each task keeps `limit` rows."""
    if project is not None:
        vectors = vectors.where(F.col("project_id") == project)
    q = vx.literal(np.asarray(query, float) / (np.linalg.norm(query) or 1.0))
    return vectors.withColumn("score", vx.dot(vx.normalise(F.col("embedding")), q)).orderBy(F.desc("score"), id_col).limit(limit)


def search_many(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id_col, score, n) of the `limit` rows of vectors nearest to each of queries (query_id, embedding), as search() for each of them; n is
    the place, from 1. Blocks of queries meet blocks of vectors, and a pair of blocks gives `limit` rows for each query."""
    shaped = lambda df, key: df.select(F.lit(0).alias("g"), F.col(key).alias("i"), vx.normalise(F.col("embedding")).alias("v"))
    xs, ys = stash(cluster.in_blocks(shaped(queries, "query_id"), "g", "xs"), "blocks"), stash(cluster.in_blocks(shaped(vectors, id_col), "g", "ys"), "blocks")
    every = lambda df, n: df.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).alias(n)).distinct()
    one = xs.join(every(ys, "y"), "g").select(F.col("_b").alias("x"), "y", "xs")
    two = ys.join(every(xs, "x"), "g").select("x", F.col("_b").alias("y"), "ys")
    schema = pa.schema([("query_id", cluster._arrow(queries, "query_id")), (id_col, cluster._arrow(vectors, id_col)), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (i, a, _), (j, b, _) = cluster._side(batch.column("xs"), k), cluster._side(batch.column("ys"), k)
                score = a @ b.T
                # all that reach the last place, so that ties are told by id
                least = np.partition(score, -limit, axis=1)[:, -limit] if limit < len(j) else score.min(1)
                p, q = np.nonzero(score >= least[:, None])
                yield cluster._batch(schema, i[p].tolist(), j[q].tolist(), score[p, q].tolist())

    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString())
    found = one.join(two, ["x", "y"]).select("xs", "ys").mapInArrow(run, f"query_id {kinds[0]}, {id_col} {kinds[1]}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("n", place).where(F.col("n") <= limit)


def pick(pools: DataFrame, limit: int, weight: float, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id_col, rank, score): maximal marginal relevance within each query's pool (query_id, id_col, embedding, score, n). Each pick weighs its
    score against its largest similarity to earlier picks; ties go to smaller n. Pools are bounded, and each is a group's work."""
    kinds = (pools.schema["query_id"].dataType.simpleString(), pools.schema[id_col].dataType.simpleString())
    schema = pa.schema([("query_id", cluster._arrow(pools, "query_id")), (id_col, cluster._arrow(pools, id_col)), ("rank", pa.int32()), ("score", pa.float64())])

    def greedy(pool: pa.Table) -> pa.Table:
        pool = pool.sort_by("n")
        x = np.array(pool.column("embedding").to_pylist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        alike, score, picks = x @ x.T, pool.column("score").to_numpy(), []
        nearest, left = np.zeros(len(x)), np.ones(len(x), dtype=bool)
        while left.any() and len(picks) < limit:
            value = np.where(left, weight * score - (1 - weight) * nearest, -np.inf)
            best = int(value.argmax())
            nearest = np.maximum(nearest, alike[best]) if picks else alike[best].copy()
            left[best] = False
            picks.append(best)
        ids = pool.column(id_col).take(pa.array(picks, pa.int64()))
        return pa.Table.from_arrays([pool.column("query_id").slice(0, len(picks)), ids, pa.array(range(1, len(picks) + 1), pa.int32()), pa.array(score[picks])], schema=schema)

    return pools.groupBy("query_id").applyInArrow(greedy, f"query_id {kinds[0]}, {id_col} {kinds[1]}, rank int, score double")


def mmr_many(vectors: DataFrame, queries: DataFrame, limit: int, weight: float = 0.6, overfetch: int = 50, id_col: str = "chunk_id") -> DataFrame:
    """pick() over the nearest max(overfetch, limit) of each of queries (query_id, embedding)."""
    pools = search_many(vectors, queries, max(overfetch, limit), id_col)
    return pick(pools.join(vectors.select(id_col, "embedding"), id_col), limit, weight, id_col)


def mmr(vectors: DataFrame, query, limit: int, weight: float = 0.6, overfetch: int = 50, project: str | None = None, id_col: str = "chunk_id") -> DataFrame:
    """(id_col, rank, score): pick() over the nearest max(overfetch, limit) of one query."""
    pool = search(vectors, query, max(overfetch, limit), project, id_col).select(F.lit(0).alias("query_id"), id_col, "embedding", "score")
    pool = pool.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)))
    return pick(pool, limit, weight, id_col).drop("query_id")


def hybrid(hits: DataFrame, query: str) -> DataFrame:
    """Adds lexical, penalty, hybrid and why to hits with score, title and text."""
    keys = F.array(*map(F.lit, query_keywords(hits, query))).cast("array<string>")
    w_sem, w_lex = F.when(F.size(keys) > 0, 0.4).otherwise(1.0), F.when(F.size(keys) > 0, 0.6).otherwise(0.0)
    out = hits.withColumn("lexical", tx.lexical_score(keys, F.col("title"), F.col("text"))).withColumn("penalty", tx.boilerplate_penalty("text"))
    out = out.withColumn("hybrid", (w_sem * F.col("score") + w_lex * F.col("lexical")) * (1 - F.col("penalty")))
    return out.withColumn("why", tx.why(F.col("score"), keys, F.col("title"), F.col("text"), F.col("penalty")))


def query_keywords(df: DataFrame, query: str) -> list[str]:
    return df.sparkSession.range(1).select(tx.keywords(F.lit(query)).alias("k")).first()["k"]


def cap_and_pack(ranked: DataFrame, score: Column, floor: float, per_session: int, limit: int, budget: int, id_col: str = "chunk_id") -> DataFrame:
    """Rows over the floor, at most per_session of a session, the best first, until limit or the token budget is reached;
    the first always fits. Adds rank (int), used_tokens (long) and truncated (whether any row was left out for limit or budget).
    Input is a bounded pool."""
    rows = ranked.withColumn("_s", score).where(F.col("_s") >= floor)
    by_session = Window.partitionBy("session_id").orderBy(F.desc("_s"), id_col)
    rows = rows.withColumn("_n", F.row_number().over(by_session)).where(F.col("_n") <= per_session)
    order = Window.orderBy(F.desc("_s"), id_col)
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("used_tokens", F.sum("token_count").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    fits = (F.col("rank") <= limit) & ((F.col("rank") == 1) | (F.col("used_tokens") <= budget))
    rows = rows.withColumn("_fits", fits).withColumn("truncated", ~F.min("_fits").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.where("_fits").drop("_s", "_n", "_fits")


def recall(chunks: DataFrame, vectors: DataFrame, sessions: DataFrame, query: str, query_vector, limit: int = 10, budget: int = 4000, project: str | None = None, min_score: float = 0.0) -> DataFrame:
    """The hybrid recall: a pool of max(16 * limit, 240) by cosine, chunk and session joined, hybrid rank, cap and pack."""
    limit, budget = min(max(limit, 1), 100), min(max(budget, 1), 200_000)
    pool = search(vectors, query_vector, max(limit * 16, 240), project).select("chunk_id", "score")
    # the pool is bounded, so it may go to the chunks
    hits = chunks.join(F.broadcast(pool), "chunk_id").join(sessions.select("session_id", "title"), "session_id", "left")
    return cap_and_pack(hybrid(hits, query), F.col("hybrid"), max(min_score, FLOOR), PER_SESSION, limit, budget)


def stats(chunks: DataFrame, used: int | None = None, project: str | None = None) -> DataFrame:
    """chunk_count, total_tokens and, of tokens returned, the compression ratio."""
    if project is not None:
        chunks = chunks.where(F.col("project_id") == project)
    out = chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"))
    return out if used is None else out.withColumn("compression_ratio", F.when(F.lit(used) > 0, F.col("total_tokens") / F.lit(float(used))).otherwise(0.0))
