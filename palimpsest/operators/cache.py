"""Caches by content, keyed merges and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cached(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """texts with hash, embedding and hit: the cache (hash, embedding) joined by the text's SHA-256."""
    rows = texts.withColumn("hash", F.sha2(F.col(text_col), 256))
    return rows.join(cache.select("hash", "embedding"), "hash", "left").withColumn("hit", F.col("embedding").isNotNull())


def misses(looked_up: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct texts to embed."""
    return looked_up.where("not hit").select("hash", text_col).dropDuplicates(["hash"])


def merge(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows, and of table those whose key isn't among them."""
    return rows.unionByName(table.join(rows.select(*key), key, "left_anti"), allowMissingColumns=True)


def prune(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """chunks without those of sessions in current (session_id, chunk_id) that current doesn't have."""
    touched = current.select("session_id").distinct()
    stale = chunks.join(touched, "session_id", "left_semi").join(current.select("chunk_id"), "chunk_id", "left_anti")
    return chunks.join(stale.select("chunk_id"), "chunk_id", "left_anti")
