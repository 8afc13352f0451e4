"""Pieces that several operators share: table access, written intermediate tables, names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.plans.materialize import Stash, shared_dir, shared_path, stash

__all__ = ["Stash", "computed_once", "lower_ascii", "partitions", "quiet_shards", "rest_of", "shared_dir", "shared_path", "stash", "table"]

#: White space of the contracts, space and code points 9 to 13, as a Java character class and as the characters themselves.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row, whatever reads them. They come out of a generator of one row, below
    which Catalyst moves no filter on them; else a filter would compute them anew, inside lambdas for every element."""
    own = rest_of(df, *columns)
    out = df.select(*own, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return out.select(*own, *(F.col(f"_once.{n}").alias(n) for n in columns))


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same where all characters are ASCII, and is faster."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def rest_of(df: DataFrame, *names: str) -> list[str]:
    """The other columns, quoted."""
    drop = {n.lower() for n in names}
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in drop]


def quiet_shards() -> None:
    """Libraries with thread pools of their own stay on the task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
