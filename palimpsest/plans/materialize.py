"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A session without one is a local one, as in tests, and gets a temporary
    folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_written: list[str] = []


def drop_all(spark: SparkSession) -> None:
    """Remove every table that this process wrote and didn't drop: at the end of a job, when no result is read any more."""
    while _written:
        delete(spark, _written.pop())


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is in use by nothing, and that drop_all removes."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


class Stash:
    """A table written to the shared folder. It cuts the lineage: a lost executor costs no earlier work,
    and a reader sees the same rows whenever it runs. Reading it back also forgets the partitioning, so
    that a join on it deals both sides itself and adaptive execution can split a hot key."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files. Only for a table that nothing lazy still reads."""
        delete(self.spark, self.path)
        if self.path in _written:
            _written.remove(self.path)


def stash(df: DataFrame, name: str) -> DataFrame:
    return Stash(df, name).df


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
