"""Token-id output: documents' ids in shards of separately compressed frames under one trained dictionary.

A shard is one binary value, written as a row of a Parquet table in the shared folder, so that Spark's commit
protocol decides what exists when executors are lost, on any file system that Spark writes to. Its layout:

    magic       8 bytes, b"PLMPTOK1"
    dictionary  32 bytes, SHA-256 of the dictionary's bytes
    n           uint64, documents
    index       n x (flag uint8), n x (doc_id int64), n x (tokens uint64), (n + 1) x (frame offset uint64)
    frames      one zstandard frame a document, of ids as little-endian uint32

The index gives any document by its offset without reading others. The dictionary is a table beside the
shards and is trained on the serialized ids of a bounded sample of documents.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions, shared_path, table
from palimpsest.llm.packing import small_batches
from palimpsest.llm.tokens import default_path, encoder

MAGIC = b"PLMPTOK1"
_SHARD_BYTES, _SHARD_DOCS = 4 << 20, 4096
_NO_ID = -(1 << 63)  # where null ids stand, first of all


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, end_id: int, path: str, sample: int = 800, size: int = 32_768, longest: int = 65_536) -> bytes:
    """A zstandard dictionary from the ids of `sample` documents, those with the smallest hash of their id. Of a document of more than
    `longest` bytes of ids so many train, from a place that the id's hash gives; of several of an id, one. Documents are
    encoded on the executors. Empty where there is too little to train on."""
    import zstandard

    chosen = [r[0] for r in docs.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
    if not chosen:
        return b""

    def encode(batches):
        e, end = encoder(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = []
            for text, h in zip(batch.column("t"), batch.column("h").to_pylist(), strict=True):
                ids = e.encode(text.as_py() or "") + end
                at = 4 * (h % max((len(ids) - longest) // 4 + 1, 1))
                out.append(ids[at : at + longest])
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(out, pa.binary())], ["i", "ids"])

    rows = docs.where(F.col(id_col).isin(chosen)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h"))
    rows = rows.mapInArrow(encode, "i long, ids binary").groupBy("i").agg(F.min("ids").alias("ids")).collect()
    try:
        return zstandard.train_dictionary(size, sorted(bytes(r["ids"]) for r in rows), k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def range_of(edges: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The range of each row by id. An id that several edges fall on, as many rows have it, has the ranges on both sides of each, which its rows
    go to by their texts' hashes: still in order of id and hash."""
    first, last = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
    many = last - first > 1
    spread = np.floor((hashes.astype(np.float64) / 2.0**64 + 0.5) * (last - first + 1)).astype(np.int64)
    return np.where(many, np.minimum(first + np.clip(spread, 0, None), last), last)


def pack_shard(dict_hash: bytes, keys: list, tokens: list[int], frames: list[bytes]) -> bytes:
    n = len(keys)
    ends = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return b"".join([
        MAGIC, dict_hash, n.to_bytes(8, "little"), bytes(k is not None for k in keys), np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array(tokens, "<u8").tobytes(), ends.tobytes(), *frames,
    ])


class Shard:
    """Random access to the documents of a shard."""

    def __init__(self, blob: bytes, dictionary: bytes):
        import zstandard

        if blob[:8] != MAGIC or blob[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        n = self.n = int.from_bytes(blob[40:48], "little")
        at = 48 + n
        self.keys = [k if f else None for f, k in zip(blob[48:at], np.frombuffer(blob, "<i8", n, at).tolist(), strict=True)]
        self.tokens = np.frombuffer(blob, "<u8", n, at + 8 * n).astype(np.int64)
        self.ends = np.frombuffer(blob, "<u8", n + 1, at + 16 * n).astype(np.int64)
        self.blob, self.base = memoryview(blob), at + 24 * n + 8
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def raw(self, k: int) -> bytes:
        """Little-endian ids of the k-th document."""
        return self.zstd.decompress(self.blob[self.base + self.ends[k] : self.base + self.ends[k + 1]])


class TokenStore:
    """A written store: `path` holds the tables `shards` (part, first, n_docs, n_tokens, blob), `dictionary` and
    `parts` (part, base: ids of all documents before that part)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])

    def read(self, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
        """id_col, start, n_tokens, ids_crc32 (long) of each document and, if asked, its ids (array of int)."""
        dictionary = self.dictionary
        # one row for each part of the writer, of which there are as many as tasks
        bases = {r["part"]: r["base"] for r in self.spark.read.parquet(f"{self.path}/parts").collect()}

        def run(batches):
            for batch in batches:
                for part, first, blob in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(), batch.column("blob"), strict=True):
                    shard = Shard(blob.as_py(), dictionary)
                    raw = (shard.raw(k) for k in range(shard.n))
                    cols = [pa.array(shard.keys, pa.int64()), pa.array(bases[part] + first + np.cumsum(shard.tokens) - shard.tokens), pa.array(shard.tokens)]
                    if ids:
                        raw = list(raw)
                        cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                    cols.insert(3, pa.array([zlib.crc32(x) for x in raw], pa.int64()))
                    yield pa.RecordBatch.from_arrays(cols, [id_col, "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

        return self.spark.read.parquet(f"{self.path}/shards").select("part", "first", "blob").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None, level: int = 3) -> TokenStore:
    """Encode every document, append end_id and write the store at `path`, in ascending order of ids.

    Documents are encoded and compressed where they are read; only frames are shuffled, to the range of ids
    that they belong to, and each range writes its shards in order.

    Null or empty text: end_id alone. Null ids come first. Repeated rows: each is a document; rows of one id follow one another
    in the order of their texts' hashes. Very long texts: one frame. Empty table: an empty store. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    small_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    dictionary = train_dictionary(docs, "_id", "_text", end_id, tokenizer)
    dict_hash = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(bytearray(dictionary), dict_hash.hex())], "bytes binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    n = partitions(spark)
    edges = docs.select(F.percentile_approx(F.coalesce("_id", F.lit(_NO_ID)), [k / n for k in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []
    edges = np.array(edges, dtype=np.int64)

    def compress(batches):
        import zstandard

        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            keys = batch.column("_id").to_pylist()
            counts, frames = [], []
            for text in batch.column("_text"):
                ids = encode(text.as_py() or "") + end
                counts.append(len(ids) // 4)
                frames.append(pack.compress(ids))
            part = range_of(edges, np.array([_NO_ID if k is None else k for k in keys], dtype=np.int64), batch.column("_hash").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.int64()), batch.column("_hash"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["part", "_id", "_hash", "n", "frame"])

    frames = docs.withColumn("_hash", F.xxhash64("_text")).mapInArrow(compress, "part int, _id long, _hash long, n long, frame binary")
    frames = frames.repartitionById(n, "part").sortWithinPartitions("part", F.asc_nulls_first("_id"), "_hash")

    def shards(batches):
        part, first, keys, counts, held, total = -1, 0, [], [], [], 0
        names = ["part", "first", "n_docs", "n_tokens", "blob"]

        def done():
            row = (part, first, len(keys), sum(counts), pack_shard(dict_hash, keys, counts, held))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

        for batch in batches:
            for p, k, c, f in zip(batch.column("part").to_pylist(), batch.column("_id").to_pylist(), batch.column("n").to_pylist(), batch.column("frame"), strict=True):
                if keys and (p != part or total >= _SHARD_BYTES or len(keys) >= _SHARD_DOCS):
                    yield done()
                    first += sum(counts)
                    keys, counts, held, total = [], [], [], 0
                if p != part:
                    part, first = p, 0
                keys.append(k)
                counts.append(c)
                held.append(f.as_py())
                total += len(held[-1])
        if keys:
            yield done()

    frames.mapInArrow(shards, "part int, first long, n_docs long, n_tokens long, blob binary").write.option("compression", "none").parquet(f"{path}/shards")
    sums = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    base, rows = 0, []
    for part, count in sorted(sums):
        rows.append((part, base))
        base += count
    spark.createDataFrame(rows, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")
    return TokenStore(spark, path)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "tokens")).read()
