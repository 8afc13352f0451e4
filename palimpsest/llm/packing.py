"""Best-fit packing of token sequences with exact-complement hashing.

Documents become pieces of at most `size` tokens; only the piece's id and length take part in packing. The
packer sees nothing but how many pieces there are of each length, at most `size` numbers whatever the
input, and plans with runs of like sequences: "so many sequences of these lengths". A piece's rank among the
pieces of its length then gives its sequence and place, in one pass over all tasks. Ranks come from a range
partitioning by length and id, so that a length that a third of all pieces have spreads over many tasks.

What fills a gap exactly is looked up: an index holds, under each sum, the single lengths, pairs and triples that make it,
and gives the first of them that the pieces that are left still allow.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import Stash, partitions, stash, table
from palimpsest.llm.tokens import default_path, encoder

_PIECES = T.StructType(
    [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


class Sums:
    """Combinations of one, two or three lengths by their sum, under availability counts (`left`, which may only fall). A sum
    holds its pairs by their longer length, and its triples by their longest, whose pair is found under the sum's
    complement; longest first. An entry that the counts don't allow any more never comes back, so that it is passed
    over for good, and all lookups of a sum together read its entries once."""

    def __init__(self, left: np.ndarray):
        self.left, size = left, len(left) - 1
        known = np.flatnonzero(left[1:] > 0) + 1
        self.known = known[::-1]
        there = np.zeros(size + 1, dtype=bool)
        there[known] = True
        self.pairs, self.triples = [np.zeros(0, np.int64)] * (size + 1), [np.zeros(0, np.int64)] * (size + 1)
        some = np.zeros(size + 1, dtype=bool)  # sums that have a pair
        for total in range(2, size + 1):
            longer = self.known[(self.known < total) & (2 * self.known >= total)]
            self.pairs[total] = longer[there[total - longer]]
            some[total] = len(self.pairs[total]) > 0
        for total in range(3, size + 1):
            longest = self.known[self.known < total - 1]
            self.triples[total] = longest[some[total - longest]]
        self.next_pair, self.next_triple = [0] * (size + 1), [0] * (size + 1)

    def single(self, total: int) -> list[int] | None:
        return [total] if self.left[total] > 0 else None

    def pair(self, total: int) -> list[int] | None:
        own, k = self.pairs[total], self.next_pair[total]
        while k < len(own):
            a = int(own[k])
            if self.left[a] > (2 * a == total) and self.left[total - a] > 0:
                break
            k += 1
        self.next_pair[total] = k
        return [a, total - a] if k < len(own) else None

    def triple(self, total: int) -> list[int] | None:
        own, k = self.triples[total], self.next_triple[total]
        while k < len(own):
            a = int(own[k])
            if self.left[a] > 0 and (two := self.pair_beside(a, total - a)):
                break
            k += 1
        self.next_triple[total] = k
        return [a, *two] if k < len(own) else None

    def pair_beside(self, a: int, total: int) -> list[int] | None:
        """A pair of this sum where one piece of length a is taken already; a pair passed over for that stays for others."""
        two = self.pair(total)
        if not two or a not in two or two.count(a) < self.left[a]:
            return two
        for b in self.pairs[total][self.next_pair[total] + 1 :].tolist():
            if self.left[b] > (2 * b == total) and self.left[total - b] > 0:
                return [b, total - b]
        return None

    def complement(self, gap: int) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly."""
        return self.single(gap) or self.pair(gap) or self.triple(gap)


class Plan:
    """Runs of like sequences. A run holds, for each slot of its pattern, pieces of one length by their rank."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.left = np.zeros(size + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(size + 1, dtype=np.int64)
        self.runs: dict[int, list[tuple[int, int, int]]] = {}  # length: (first rank, first sequence, offset)
        self.sequences = 0
        self.gaps: dict[int, list[list[int]]] = {}  # gap: [first sequence, how many]
        self._open: list[int] = []
        self.take([size], int(self.left[size]))
        self.fill_exactly()
        self.fit_rest()

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.setdefault(length, []).append((int(self.used[length]), sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def take(self, pattern: list[int], n: int) -> None:
        """n new sequences, each holding the lengths of pattern."""
        if n:
            offset = 0
            for length in pattern:
                self.put(length, n, self.sequences, offset)
                offset += length
            self.sequences += n

    def fill_exactly(self) -> None:
        sums = Sums(self.left)
        for length in range(self.size - 1, 0, -1):
            while self.left[length] > 0:
                # the piece itself is out of the counts meanwhile; an entry passed over for want of it could only serve sequences
                # that hold it, and these are all found here
                self.left[length] -= 1
                others = sums.complement(self.size - length)
                self.left[length] += 1
                if others is None:
                    break
                pattern = [length, *others]
                self.take(pattern, min(int(self.left[x]) // pattern.count(x) for x in pattern))

    def gap(self, room: int, sequence: int, n: int) -> None:
        if room and n:
            if room not in self.gaps:
                insort(self._open, room)
                self.gaps[room] = []
            self.gaps[room].append([sequence, n])

    def stack(self, length: int, each: int, n: int, sequence: int, room: int) -> None:
        """`each` pieces into every one of n sequences."""
        for k in range(each):
            self.put(length, n, sequence, self.size - room + k * length)
        self.gap(room - each * length, sequence, n)

    def fit_rest(self) -> None:
        """Best fit, longest first, for all pieces of a length at once."""
        for length in range(self.size - 1, 0, -1):
            while n := int(self.left[length]):
                k = bisect_left(self._open, length)
                if k < len(self._open):
                    room = self._open[k]
                    sequence, there = self.gaps[room].pop()
                else:
                    room, sequence, there = self.size, self.sequences, -(-n // (self.size // length))
                    self.sequences += there
                each = min(room // length, n)
                use = min(there, n // each)
                if k < len(self._open):
                    if there > use:
                        self.gaps[room].append([sequence + use, there - use])
                    if not self.gaps[room]:
                        del self.gaps[room]
                        self._open.pop(k)
                    self.stack(length, each, use, sequence, room)
                else:
                    self.stack(length, each, use, sequence, room)
                    if there > use:  # one more, with what is left over
                        self.stack(length, n - each * use, 1, sequence + use, room)

    def arrays(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) for length, runs in self.runs.items()}


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first have size tokens."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, end_id: int, path: str) -> DataFrame:
    """A row for each piece of each document."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        encode, end = encoder(path).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    for col, x in zip(cols, (key, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        col.append(x)
            types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField(id_col, kind), *_PIECES]))


def small_batches(spark: SparkSession) -> None:
    """Documents travel to Python few at a time, as some are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Where each piece of each document goes: id_col, piece (int, from 0), start, length, ids_crc32,
    sequence_id and offset (long). A document is its ids and end_id; those of more than size tokens are cut into
    pieces of size tokens, of which the first may be shorter. Sequences are filled without gaps from 0.

    Patterns of one length and one, two or three others that fill a sequence exactly come first, longest
    length first and as often as there are pieces; best fit places what is left.

    Null or empty text: the end id alone. Null ids and repeated rows: each row is a document of its own.
    Very long texts: as many pieces as they take. Empty table: empty result. Other columns of docs are not read. Token ids of the sequences: sequences().
    """
    spark = docs.sparkSession
    path = path or default_path()
    n = partitions(spark)
    cut_up = Stash(pieces(docs, id_col, text_col, size, end_id, path), "pieces")
    schema = cut_up.df.schema

    def rank(batches):
        """The place of each row among those of its length in this task. Rows come sorted by length."""
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            at = np.empty(len(lengths), dtype=np.int64)
            edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1), len(lengths)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    at[a:b] = np.arange(b - a) + seen.get(length := int(lengths[a]), 0)
                    seen[length] = seen.get(length, 0) + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, dtype=np.int64)), pa.array(at)], [*batch.schema.names, "_part", "_rank"])

    keys = ["length", f"`{id_col}`", "piece"]
    ranked = cut_up.df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(
        rank, T.StructType([*schema, T.StructField("_part", T.LongType()), T.StructField("_rank", T.LongType())])
    )
    ranked = stash(ranked, "ranked")
    cut_up.drop()
    # lengths are spread over tasks by range: at most size + tasks rows
    base, totals = {}, {}
    for row in sorted(ranked.groupBy("_part", "length").count().collect()):
        base[row[0], row[1]] = totals.get(row[1], 0)
        totals[row[1]] = totals.get(row[1], 0) + row[2]
    runs = Plan(totals, size).arrays()

    def place(batches):
        for batch in batches:
            parts, lengths, at = (batch.column(c).to_numpy() for c in ("_part", "length", "_rank"))
            sequence, offset = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
            for key in {*zip(parts.tolist(), lengths.tolist(), strict=True)}:
                own = (parts == key[0]) & (lengths == key[1])
                first, seq, off = runs[key[1]]
                r = at[own] + base[key]
                k = np.searchsorted(first, r, "right") - 1
                sequence[own], offset[own] = seq[k] + r - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType([*schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (array of int), from the documents and best_fit_pack's
    rows. Ids of documents must be unique and not null."""
    path = path or default_path()

    def run(batches):
        encode, end = encoder(path).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids = []
            for text, start, length in zip(batch.column("text"), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True):
                ids.append(np.frombuffer(encode(text.as_py() or "") + end, "<u4")[start : start + length].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("offset"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = packed.select(F.col(f"`{id_col}`").alias("_id"), "sequence_id", "offset", "start", "length")
    parts = placed.join(texts, "_id").select("text", "start", "length", "sequence_id", "offset").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
