"""Lines of files by bytes: files are cut into ranges that tasks read for themselves, from any offset on.

A line is what lies between newlines; it belongs to the range in which it begins, so that every byte of a file is one range's. Whether it is
UTF-8 is asked of each line alone. Files are opened by their address (local, s3, gs, hdfs: what pyarrow opens); those of other
file systems are read by Spark, as a whole. What can't be opened or read gives a row that says so, and no other file suffers.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a range, and of a file read at a time.
RANGE, CHUNK = 64 << 20, 1 << 20
#: Bytes before an offset by which a file is known to have only grown.
TAIL = 256
OPENED = ("", "file", "s3", "gs", "gcs", "hdfs")
_ROWS = 4096
_SCHEMA = "path string, first long, k long, at long, line binary, ended boolean, lines long, bytes long, sha string, error string"


def scheme(path):
    return F.regexp_extract(path, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)


def opened(path: str):
    """A file for reading at any place."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return open(re.sub("^file:/+", "/", path), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def lines_of(f, start: int, first: int, last: int, length: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, whether a newline ends it) of the lines that begin from first to before last, of a file read from start to length. A line that
    an offset before start began isn't told apart: start has to be where a line begins, or ends."""
    base = first if first == start else first - 1
    skipping = first > start
    f.seek(base)
    held, at = b"", base
    while True:
        data = f.read(min(max(CHUNK, len(held)), length - at))
        if not data:
            if held and not skipping:
                yield base, held, False
            return
        at += len(data)
        *whole, held = (held + data).split(b"\n")
        for x in whole:
            if not skipping:
                yield base, x, True
            skipping = False
            base += len(x) + 1
            if base >= last:
                return


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that stand for much work each, dealt to all tasks: by a given number, which adaptive execution doesn't reduce because they are small."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, start, first, last, length, content) of files (path, start, length): ranges of at most size bytes. content is null where tasks open the
    file themselves; a file that only Spark can open is one range, with its content."""
    own = files.select("path", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("length").cast("long").alias("length")).where("length > start")
    mine = scheme("path").isin(*OPENED)
    cut = own.where(mine).select("path", "start", "length", F.explode(F.sequence("start", F.col("length") - 1, F.lit(size).cast("long"))).alias("first"))
    return cut.select("path", "start", "first", F.least(F.col("first") + size, "length").alias("last"), "length", F.lit(None).cast("binary").alias("content"))


def by_spark(files: DataFrame) -> DataFrame:
    """ranges() of the files that only Spark can open. Their paths go to the driver, as the list of files of any read does."""
    own = files.where(~scheme("path").isin(*OPENED)).select("path", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    paths = [r["path"] for r in own.select("path").collect()]
    if not paths:
        return own.select("path", "start", F.col("start").alias("first"), F.col("length").alias("last"), "length", F.lit(None).cast("binary").alias("content")).limit(0)
    content = files.sparkSession.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(paths).select("path", "content")
    return own.join(content, "path", "left").select("path", "start", F.col("start").alias("first"), F.col("length").alias("last"), "length", F.coalesce("content", F.lit(b"")).alias("content"))


def read(parts: DataFrame) -> DataFrame:
    """Rows of two kinds, of ranges: lines that aren't empty (line, its offset at, its number k in the range, and whether a newline ended it);
    and one for each range: how many newlines (lines) and bytes its lines have, the SHA-256 of these, and error where the file can't be read."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for part in batch.to_pylist():
                path, first, rows, size, k, n = part["path"], part["first"], [], 0, 0, 0
                sha, error = hashlib.sha256(), None
                try:
                    with opened(path) if part["content"] is None else io.BytesIO(part["content"]) as f:
                        for at, line, ended in lines_of(f, part["start"], first, part["last"], part["length"]):
                            sha.update(line + b"\n" * ended)
                            n += len(line) + ended
                            if line:
                                rows.append((path, first, k, at, line, ended, None, None, None, None))
                                size += len(line)
                            k += ended
                            if len(rows) >= _ROWS or size >= CHUNK:
                                yield done(rows)
                                rows, size = [], 0
                except OSError as e:
                    error = str(e)[:500] or type(e).__name__
                rows.append((path, first, None, None, None, None, k, n, sha.hexdigest(), error))
                yield done(rows)

    return dealt(parts, "path", "first").mapInArrow(run, _SCHEMA)


def numbered(rows: DataFrame) -> DataFrame:
    """(path, first, line_no, at, line, ended) of read() rows that are written: lines numbered in their file, by sums over its ranges."""
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    base = rows.where("lines is not null").select("path", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.where("line is not null").join(base, ["path", "first"]).select("path", "first", (F.col("before") + F.col("k")).alias("line_no"), "at", "line", "ended")


def valid(line: str = "line"):
    """A line as text; null where its bytes aren't UTF-8."""
    return F.try_validate_utf8(F.col(line).cast("string"))


def tails(files: DataFrame, at: str) -> DataFrame:
    """(path, tail, ended, next) of files (path, a column of offsets): a hash of the bytes before the offset, whether the last of them is a newline, and
    the byte that follows (null at the end); nothing of files that can't be read so far."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with opened(path) as f:
                        lo = max(at - TAIL, 0)
                        f.seek(lo)
                        own = f.read(at - lo + 1)
                except OSError:
                    continue
                if len(own) >= at - lo:
                    rows.append((path, hashlib.sha256(own[: at - lo]).hexdigest(), own[: at - lo].endswith(b"\n"), own[at - lo :] or None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.binary()), strict=True)], ["path", "tail", "ended", "next"])

    return files.select("path", F.col(at).cast("long")).where(scheme("path").isin(*OPENED)).mapInArrow(run, "path string, tail string, ended boolean, next binary")


def hashes(files: DataFrame) -> DataFrame:
    """(path, sha): the SHA-256 of files, read in pieces; nothing of those that can't be read."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                sha = hashlib.sha256()
                try:
                    with opened(path) as f:
                        while data := f.read(CHUNK):
                            sha.update(data)
                except OSError:
                    continue
                rows.append((path, sha.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "sha"])

    mine = files.select("path").where(scheme("path").isin(*OPENED))
    mine = dealt(mine, "path").mapInArrow(run, "path string, sha string")
    other = [r["path"] for r in files.select("path").where(~scheme("path").isin(*OPENED)).collect()]
    if not other:
        return mine
    content = files.sparkSession.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(other)
    return mine.unionByName(content.select("path", F.sha2("content", 256).alias("sha")))
