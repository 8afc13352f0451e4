"""MinHash near-dedup with SetSketch registers.

1. One pass over the documents makes each one's set of word shingles, a 128-bit fingerprint of the set, and a
   sketch of `ROWS * BANDS` registers. A register holds floor(1 - log_b x), kept within 16 bits, of the smallest
   exponential variate x that the set's members draw for it: exponentially spaced truncated minima. Registers of a
   union are the maxima of registers, and equal registers are as frequent as the sets are alike (Jaccard).
2. Equal sets become one class; only its representative, the smallest id, goes on. A third of all documents that
   are one text are one row here.
3. ROWS registers are a band. Documents with an equal band share a bucket. With 4 rows and 24 bands, a pair of
   similarity 0.85 shares none with a probability of 2e-8, one of 0.8 with 3e-6.
4. Links within buckets, without emitting all pairs of one: a round takes, in every bucket that holds several
   components so far, some members outside its largest component, compares them with all those of other
   components, and merges components. The first rounds take few, so that components form; the last takes all,
   after which every two members of different components have met. Buckets all of whose members outside the largest
   component were taken are done. There is no cap.
5. Members meet in blocks: a row of the join is a block of sketches against another, and a pair comes out once, in its
   first common band, if the sketches' joint likelihood allows it: unless the likelihood at the threshold is
   below e^-SLACK of the largest. In buckets of many members, where many pairs are nearly alike, the sets' hashes
   cut to 16 or 32 bits, whose common part is never less than that of the sets, sort out most others at once. Then
   the full sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import Stash, stash, table
from palimpsest.operators.components import components
from palimpsest.llm.packing import small_batches
from palimpsest.llm.shingles import mix, shingle_sets

ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
_B, _A, _MOST = 1.001, 20.0, 65_535  # base, rate and largest register
_DRAWS = mix(np.arange(REGISTERS, dtype=np.uint64), 7) | np.uint64(1)
#: Ids that a task may hold as a hash table, about 50 MB.
_BROADCAST_IDS = 1_000_000
#: Sketches in a block, and members that meet all others of a bucket in the first rounds.
_BLOCK, _TAKEN = 256, (1, 4)
_PAIRS = 4096  # worked on at a time
_NARROW = 2000
SLACK = 12.0


def registers(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of registers for each set; all zero for empty sets."""
    out = np.zeros((len(at) - 1, REGISTERS), dtype="<u2")
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        least = np.empty((REGISTERS, len(full)), dtype=np.uint64)
        starts = at[:-1][full]
        for k, draw in enumerate(_DRAWS):
            least[k] = np.minimum.reduceat(flat * draw, starts)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / _A
        out[full] = np.clip(np.floor(1 - np.log(x) / np.log(_B)), 0, _MOST).T.astype("<u2")
    return out


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, slack: float = SLACK) -> np.ndarray:
    """Whether each pair of register rows, of sets of n_a and n_b members, can be of similarity `least` or more: its
    log likelihood there is within slack of the largest below, by a grid of similarities."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.append(np.linspace(0, least, 60), least)[None] * np.ones_like(u)
    j = np.minimum(j, np.minimum(u / v, v / u))

    def p(x):
        return np.clip(-np.log1p(-np.maximum(x, 0) * (_B - 1) / _B) / np.log(_B), 1e-9, 1)

    up, down = p(u - v * j), p(v - u * j)
    log = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))
    return log[:, -1] >= log.max(1) - slack


def sketches(docs: DataFrame) -> DataFrame:
    """(_id, n, fp_a, fp_b, regs) of docs' (_id, _text)."""

    def run(batches):
        for batch in batches:
            flat, at = shingle_sets([(t.as_py() or "").encode() for t in batch.column("_text")])
            regs = registers(flat, at)
            sums = np.zeros((2, len(flat) + 1), dtype=np.uint64)
            for k in range(2):
                np.cumsum(mix(flat, 11 + k), out=sums[k, 1:])
            a, b = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(a), pa.array(b), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["_id", "n", "fp_a", "fp_b", "regs"],
            )

    kind = docs.schema["_id"].dataType
    small_batches(docs.sparkSession)
    fields = [T.StructField("_id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "fp_a", "fp_b")), T.StructField("regs", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType(fields))


def meet(chosen: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows of chosen and members (key, band, _id, comp, n, regs, cut) of one key, of different components,
    that can be links by their sketches. No row of the join holds more than a block of either side."""
    kind = members.schema["_id"].dataType
    block = F.floor(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) % F.greatest(F.col("c") / _BLOCK, F.lit(1)))

    def packed(rows: DataFrame, side: str) -> DataFrame:
        own = rows.groupBy("key", block.alias(f"block_{side}")).agg(F.min("band").alias(f"band_{side}"), F.collect_list(F.struct("_id", "comp", "n", "regs", "cut")).alias(side))
        return own

    def gate(batches):
        for batch in batches:
            out = [[], []]
            for band, x, y in zip(batch.column("band_x").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                one, two = ({c: v.field(c) for c in ("_id", "comp", "n", "regs", "cut")} for v in (x.values, y.values))
                regs = [np.frombuffer(b"".join(v["regs"].to_pylist()), "<u2").reshape(-1, REGISTERS) for v in (one, two)]
                n = [v["n"].to_numpy() for v in (one, two)]
                comp = [v["comp"].to_pylist() for v in (one, two)]
                ids = [v["_id"].to_pylist() for v in (one, two)]
                code = {c: k for k, c in enumerate(dict.fromkeys(comp[0] + comp[1]))}
                comp = [np.array([code[c] for c in v]) for v in comp]
                fits = (comp[0][:, None] != comp[1][None]) & (100 * np.minimum(n[0][:, None], n[1][None]) >= percent * np.maximum(n[0][:, None], n[1][None]))
                every_i, every_j = np.nonzero(fits)
                cuts = None
                for at in range(0, len(every_i), _PAIRS):
                    i, j = every_i[at : at + _PAIRS], every_j[at : at + _PAIRS]
                    u, v = regs[0][i], regs[1][j]
                    here = (u == v).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
                    i, j, u, v = i[here], j[here], u[here], v[here]
                    yes = likely(u, v, n[0][i].astype(float), n[1][j].astype(float), percent / 100)
                    if cuts is None and yes.any():
                        cuts = [c["cut"].to_pylist() for c in (one, two)]
                    for p, q in zip(i[yes].tolist(), j[yes].tolist(), strict=True):
                        if cuts[0][p] is not None:
                            size = int(n[0][p] + n[1][q])
                            common = most_common(cuts[0][p], int(n[0][p]), cuts[1][q], int(n[1][q]))
                            if 100 * common < percent * (size - common):
                                continue
                        out[0].append(min(ids[0][p], ids[1][q]))
                        out[1].append(max(ids[0][p], ids[1][q]))
            if out[0]:
                t = pa.from_numpy_dtype(np.int64) if kind == T.LongType() else None
                yield pa.RecordBatch.from_arrays([pa.array(out[0], t), pa.array(out[1], t)], ["a", "b"])

    both = packed(chosen, "x").join(packed(members, "y"), "key")
    return both.select("band_x", "x", "y").mapInArrow(gate, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No less than the number of common members of two sets, from their cut hashes."""
    x, y = (np.frombuffer(v, "<u2" if n <= _NARROW else "<u4") for v, n in ((a, n_a), (b, n_b)))
    if x.dtype != y.dtype:
        x, y = (v if v.dtype == np.dtype("<u2") else (v >> 16).astype("<u2") for v in (x, y))
    x, y = (v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v for v in (x, y))  # they come sorted
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) + min(n_a - len(x), n_b - len(y))


def cut_sets(texts: DataFrame) -> DataFrame:
    """(_id, cut): the sets of texts' (_id, _text), cut to 16 bits a hash, or to 32 for sets of over _NARROW."""

    def run(batches):
        for batch in batches:
            flat, at = shingle_sets([(t.as_py() or "").encode() for t in batch.column("_text")])
            own = [flat[a:b] >> np.uint64(48 if b - a <= _NARROW else 32) for a, b in zip(at, at[1:], strict=False)]
            own = [x.astype("<u2" if len(x) <= _NARROW else "<u4").tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(own, pa.binary())], ["_id", "cut"])

    return texts.mapInArrow(run, T.StructType([T.StructField("_id", texts.schema["_id"].dataType), T.StructField("cut", T.BinaryType())]))


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType

    def run(batches):
        for x in batches:
            own, known = [], {}  # a text that many pairs share is made into a set once a batch
            names = [(k, t.as_py()) for c in ("a", "b") for k, t in zip(x.column(c).to_pylist(), x.column(f"text_{c}"), strict=True)]
            for name in dict.fromkeys(names):
                known[name] = shingle_sets([(name[1] or "").encode()])[0]
            for k in range(x.num_rows):
                both = np.concatenate([known[names[k]], known[names[k + x.num_rows]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                own.append(100 * common >= percent * (len(both) - common))
            yield x.select(["a", "b"]).filter(pa.array(own, pa.bool_()))

    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("_id").alias(c), F.col("_text").alias(f"text_{c}")), c)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def if_few(rows: DataFrame) -> DataFrame:
    """Narrow rows of a written table, marked for broadcast where counting shows them to be few enough."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST_IDS else rows


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """id_col, n_shingles (long), component_id and kept (boolean) of each row.

    A-Z are lower-cased; words are runs without space and code points 9 to 13; a set is the distinct shingles of
    five words, or the whole sequence of fewer words. Two documents are linked if 100 * intersection size >=
    percent * union size. component_id is the smallest id that links reach, kept whether it is the row's own.

    Null, empty or wordless text: no shingles, linked with nothing. Null ids: linked with nothing, component_id
    null, kept. Repeated rows: each is returned; rows of one id are one document to links, and kept alike.
    Very long texts: whole, hashed in blocks of 1 MB. Empty table: empty result. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    every = stash(sketches(docs), "sketches")
    sets = Stash(
        every.where("n > 0 and _id is not null").groupBy("fp_a", "fp_b", "n").agg(F.min("_id").alias("_id"), F.min("regs").alias("regs")), "classes"
    ).df
    width = 2 * ROWS  # bytes
    bands = sets.select("_id", F.posexplode(F.array(*(F.xxhash64(F.lit(k), F.substring("regs", k * width + 1, width)) for k in range(BANDS)))).alias("band", "key"))
    shared = Stash(bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "buckets")
    members = Stash(bands.join(shared.df, "key"), "members")
    ids = members.df.select("_id").distinct()
    ids = Stash(ids, "ids").df
    texts = Stash(docs.join(if_few(ids), "_id", "left_semi"), "texts")
    links: list[DataFrame] = []
    comp: Stash | None = None
    cuts: DataFrame | None = None
    for taken in (*_TAKEN, None):
        now = members.df
        if comp is None:
            now = now.withColumn("comp", F.col("_id"))
        else:
            now = now.join(if_few(comp.df.withColumnRenamed("node", "_id")), "_id", "left").withColumn("comp", F.coalesce("comp", "_id"))
        now = Stash(now, "members")
        # buckets of several components and the largest of each, from a row for each key, component and task
        sizes = now.df.groupBy("key", "comp").agg(F.count("*").alias("k"))
        several = sizes.groupBy("key").agg(F.sum("k").alias("c"), F.max(F.struct("k", "comp")).alias("m"))
        several = Stash(several.select("key", "c", F.col("m.comp").alias("most"), (F.col("c") - F.col("m.k")).alias("others")).where("others > 0"), "several")
        open_now = Stash(now.df.join(if_few(several.df), "key").select("key", "band", "_id", "comp", "most", "c", "others"), "open")
        if open_now.df.isEmpty():
            break
        chosen = open_now.df.where("comp <> most")
        if taken:
            w = Window.partitionBy("key").orderBy(F.xxhash64("_id", F.lit(taken)), "_id")
            chosen = chosen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= taken).drop("_r")
        if links and cuts is None:
            ids = Stash(open_now.df.select("_id").distinct(), "ids").df
            cuts = stash(cut_sets(texts.df.join(if_few(ids), "_id", "left_semi")), "cut-sets")
        sketch = sets.select("_id", "n", "regs")
        sketch = sketch.join(cuts, "_id") if cuts is not None else sketch.withColumn("cut", F.lit(None).cast("binary"))
        pairs = Stash(meet(chosen.join(sketch, "_id"), open_now.df.join(sketch, "_id"), percent), "pairs")
        links.append(stash(verify(pairs.df.distinct(), texts.df, percent), "links"))
        every_link = links[0]
        for x in links[1:]:
            every_link = every_link.union(x)
        comp = components(every_link)
        for done in (members, now, several, pairs):
            done.drop()
        members = Stash(open_now.df.where(F.col("others") > (taken or 0)).select("key", "band", "_id"), "members")
        open_now.drop()
    for done in (members, texts, shared):
        done.drop()
    out = every.join(sets.select("fp_a", "fp_b", "n", F.col("_id").alias("_rep")), ["fp_a", "fp_b", "n"], "left")
    if comp is not None:
        out = out.join(comp.df.withColumnRenamed("node", "_rep"), "_rep", "left")
        found = F.coalesce("comp", "_rep", "_id")
    else:
        found = F.coalesce("_rep", "_id")
    found = F.when(F.col("_id").isNotNull(), found)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(found == F.col("_id"), F.lit(True)).alias("kept"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(table(spark, sf_dir, "documents"), percent=85)
