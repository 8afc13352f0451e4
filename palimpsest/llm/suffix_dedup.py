"""Repeated-substring dedup by longest previous factors in suffix order, worked out bucket by bucket.

A suffix has an earlier match of `least` bytes iff its longest previous factor is at least that long. Suffixes that can
share so much are brought together and put in order there (`factors`):

1. Each window of `least` bytes has an anchor, the gram of `_GRAM` bytes in it with the smallest hash; equal windows
   have the same anchor at the same place. One pass finds all anchors, about one in `(least - _GRAM) / 2` bytes,
   and a hash of the bytes around each that its windows can cover, its context.
2. Anchors whose gram is found twice or more are kept. Those with the same gram and context form a class: all their
   windows repeat, and the smallest position of the class is the earlier match of all others. A text copied to a third of
   all documents is a few classes, whatever its copies.
3. One context of each class that shares its gram with another class is fetched. Within a gram, contexts are put in
   suffix order by their bytes, and previous and next smaller positions give the longest previous factor at every place.
4. A gram of more than `_GATHER` classes is dealt out by ranges of places, a range by narrower ones: contexts meet again
   only if they agree in the bytes that all windows of the range have in common, and are one class if they agree in all
   bytes that the range's windows cover. At a range of one place the two are the same, so no task holds more than `_GATHER`
   contexts of a bucket.
5. Places whose factors are long enough go back to the anchors' documents, where their bytes are united and removed.

On every path, equal strings of a class are told by 128 bits of hash or more (gram and context), and those of different
classes are compared by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Stash, stash, table
from palimpsest.llm.factors import factors
from palimpsest.llm.packing import small_batches
from palimpsest.llm.shingles import mix, powers

_GRAM = 128
_BLOCK = 1 << 20  # bytes of a long text worked on at a time; the arrays take 35 times as much, and 120 times where all bytes are equal
_RUN = 1 << 15  # bytes of shorter texts worked on at a time, so that the arrays stay in a core's cache
_GATHER = 256  # classes of a bucket that meet in one task
_SPLIT = 4  # ranges that a range of places is dealt to
_ROWS = 4096  # contexts put in order at a time, and whole buckets beyond
_FETCH = 4096  # contexts that leave a task together
_MARKS = 4096  # marks of places unpacked at a time
_BROADCAST = 1_000_000  # grams, about 50 MB as a hash table
_TOP = np.uint32((1 << 32) - 1)


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers along the last axis, with a zero in front: hashes of all substrings."""
    up, _ = powers(data.shape[-1] + 1)
    sums = np.zeros((*data.shape[:-1], data.shape[-1] + 1), dtype=np.uint64)
    own = _BYTES[data]
    own *= up[: data.shape[-1]]
    np.cumsum(own, axis=-1, out=sums[..., 1:])
    return sums


_BYTES = mix(np.arange(256, dtype=np.uint64), 21)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width], for each i that has so many, from those of powers of two."""
    n, w = len(x) - width + 1, 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[:n], x[width - w : width - w + n])


def anchors(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(text number, offset, gram hash, context hash) of the anchors of all windows of the texts."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(lengths)
    if not len(data) or lengths.max() < least:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    sums = _prefix(data)
    _, down = powers(len(data) + 1)
    n, width = len(data), least - _GRAM + 1
    # grams are ordered by the upper half of a hash; of equal halves all are anchors, so that equal windows still have the same
    half = np.full(n, _TOP)
    full = sums[_GRAM:] - sums[:-_GRAM]
    full *= down[: len(full)]
    np.clip((full >> np.uint64(32)).astype(np.uint32), np.uint32(1), _TOP - np.uint32(1), out=half[: len(full)])
    starts = ends - lengths
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        half[max(a, b - _GRAM + 1) : b] = _TOP
    small = np.zeros(n, dtype=np.uint32)
    small[: n - width + 1] = _smallest(half, width)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        small[max(a, b - least + 1) : b] = 0  # no window here
    # an anchor is the smallest of some window that holds it: no window has a larger one, so the largest of all smallest ones tells. The windows
    # that hold a gram are a stretch of those that are left, in which stretches of one smallest gram are looked at once
    begins = np.concatenate([[0], np.flatnonzero(small[1:] != small[:-1]) + 1])
    value = small[begins]
    q = np.flatnonzero(half <= value.max())
    q = q[half[q] != _TOP]
    number = np.searchsorted(ends, q, "right")
    first = starts[number]
    stretch = np.empty(2 * len(q), dtype=np.int64)
    stretch[::2], stretch[1::2] = np.searchsorted(begins, np.maximum(q - (width - 1), first), "right") - 1, np.searchsorted(begins, q, "right")
    best = np.maximum.reduceat(np.append(value, np.uint32(0)), stretch)[::2] if len(q) else value[:0]
    hit = best == half[q]
    q, number, first = q[hit], number[hit], first[hit]
    lo, hi = np.maximum(q - (width - 1), first), np.minimum(q + least, ends[number])
    around = mix((sums[hi] - sums[lo]) * down[lo] + mix(((q - lo) * (4 * least) + (hi - q)).astype(np.uint64), 5))
    return number, q - first, mix(full[q]).view(np.int64), around.view(np.int64)


def text_anchors(text: bytes, least: int) -> tuple[np.ndarray, ...]:
    """anchors() of one long text, a block of windows at a time."""
    parts = []
    for s in range(0, max(len(text) - least + 1, 1), _BLOCK):
        lo, hi = max(s - least, 0), min(s + _BLOCK + 2 * least, len(text))
        _, q, gram, around = anchors([text[lo:hi]], least)
        # windows of the block's outer parts are whole here too, but their contexts may not be
        inner = ((q + lo >= s) | (lo == 0)) & ((q + lo < s + _BLOCK + least) | (hi == len(text)))
        parts.append((q[inner] + lo, gram[inner], around[inner]))
    q, gram, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, once = np.unique(q, return_index=True)
    return np.zeros(len(once), np.int64), q[once], gram[once], around[once]


def ranges(least: int, level: int) -> list[tuple[int, int]]:
    """First and last place of each range of a level; those of a level lie within those of the level before."""
    width = least - _GRAM + 1
    n = min(_SPLIT**level, width)
    edges = [k * width // n for k in range(n + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def levels(least: int) -> int:
    """The level whose ranges are single places."""
    level = 0
    while _SPLIT**level < least - _GRAM + 1:
        level += 1
    return level


def in_runs(sizes: list[int], most: int) -> list[list[int]]:
    """Numbers of texts in runs of at most `most` bytes together; a longer text is a run of its own."""
    out, size = [], most + 1
    for k, n in enumerate(sizes):
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(k)
        size += n
    return out


def range_hashes(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, inside: np.ndarray, level: int, least: int):
    """(row, range, hash of the bytes that all windows of the range share, hash of all bytes that they cover) for each range of
    the level that lies in the context's range of the level before (`inside`) and at whose places it has windows."""
    sums = _prefix(rows)
    _, down = powers(rows.shape[1] + 1)
    hashes = lambda own, a, b: mix((sums[own, b] - sums[own, a]) * down[a])
    above, out, k = ranges(least, level - 1), [], 0
    for n, (first, last) in enumerate(ranges(least, level)):
        k += first > above[k][1]
        own = np.flatnonzero((inside == k) & (lo <= last) & (hi >= first + least))
        if len(own):
            a, b = np.maximum(lo[own], first), np.minimum(hi[own], last + least)
            core = hashes(own, np.full(len(own), last), np.full(len(own), first + least))
            out.append((own, np.full(len(own), n), core, mix(hashes(own, a, b) + mix(((a - first) * (4 * least) + (last + least - b)).astype(np.uint64), 5))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))


def range_bits(least: int, level: int) -> list[bytes]:
    """For each range of a level, its places as bits."""
    grid = np.zeros((len(ranges(least, level)), least - _GRAM + 1), dtype=bool)
    for k, (first, last) in enumerate(ranges(least, level)):
        grid[k, first : last + 1] = True
    return [x.tobytes() for x in np.packbits(grid, axis=1)]


def _contexts(batch: pa.RecordBatch, least: int):
    left, text = batch.column("left").to_numpy().astype(np.int64), batch.column("context").to_pylist()
    middle = least - _GRAM
    rows = np.zeros((len(text), middle + least), dtype=np.uint8)
    lo = middle - left
    hi = lo + np.array([len(t) for t in text], dtype=np.int64)
    for k, t in enumerate(text):
        rows[k, lo[k] : hi[k]] = np.frombuffer(t, dtype=np.uint8)
    return rows, lo, hi


def spans(docs: DataFrame, least: int, keep: str) -> DataFrame:
    """(_a, _b, own): the windows to remove, of docs' (_a, _b, _text) with one row for each (_a, _b)."""
    middle = least - _GRAM

    def find(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("_text")]
            found = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
            for own in in_runs([len(t) for t in texts], _RUN):
                f = anchors([texts[k] for k in own], least) if len(texts[own[0]]) <= _BLOCK else text_anchors(texts[own[0]], least)
                for to, x in zip(found, (np.array(own, dtype=np.int64)[f[0]], *f[1:]), strict=True):
                    to.append(x)
            k, q, gram, around = (np.concatenate(x) for x in found)
            take = pa.array(k)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(around), batch.column("_a").take(take), batch.column("_b").take(take), pa.array(q)], ["g", "c", "_a", "_b", "q"])

    every = Stash(docs.mapInArrow(find, "g long, c long, _a long, _b long, q long"), "anchors")
    twice = Stash(every.df.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "grams")
    few = twice.df.count() <= _BROADCAST
    here = Stash(every.df.join(F.broadcast(twice.df) if few else twice.df, "g", "left_semi"), "repeated")
    every.drop()
    classes = Stash(here.df.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("_a", "_b", "q")).alias("p")), "anchor-classes")
    groups = Stash(classes.df.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "anchor-groups")
    need = classes.df.join(groups.df, "g").select("g", "c", "m", "p._a", "p._b", "p.q")
    lists = need.groupBy("_a", "_b").agg(F.collect_list(F.struct("g", "c", "m", "q")).alias("own"))

    def fetch(batches):
        types, names = [pa.int64()] * 6 + [pa.int32(), pa.binary()], ["g", "c", "m", "_a", "_b", "q", "left", "context"]
        for batch in batches:
            owner, own = listed(batch.column("own"))
            data, starts, ends = flat(batch.column("_text"))
            q = own.field("q").to_numpy()
            lo = starts[owner] + np.maximum(q - middle, 0)
            hi = np.minimum(starts[owner] + q + least, ends[owner])
            left = (starts[owner] + q - lo).astype(np.int32)
            data = data.tobytes()
            for k in range(0, len(q), _FETCH):
                part, take = slice(k, k + _FETCH), pa.array(owner[k : k + _FETCH])
                text = [data[a:b] for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)]
                cols = [*(own.field(x)[part] for x in ("g", "c", "m")), *(batch.column(x).take(take) for x in ("_a", "_b")), own.field("q")[part], pa.array(left[part])]
                yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(cols, types, strict=False)), pa.array(text, pa.binary())], names)

    contexts = Stash(docs.join(lists, ["_a", "_b"]).select("_a", "_b", "_text", "own").mapInArrow(fetch, "g long, c long, m long, _a long, _b long, q long, left int, context binary"), "contexts")

    def judge(batches):
        """Rows come with those of a bucket together, and of a class; a batch's last bucket waits for the next batch."""
        held: pa.Table | None = None

        def done(part: pa.Table):
            part = part.combine_chunks().to_batches()[0]
            rows, lo, hi = _contexts(part, least)
            position = np.empty(part.num_rows, dtype=np.int64)
            position[np.lexsort([part.column(x).to_numpy() for x in ("q", "_b", "_a")])] = np.arange(part.num_rows)
            previous, other = factors(rows, lo, hi, part.column("bucket").to_numpy(), position, middle, least)
            enough = (other if keep == "none" else previous) >= least
            hit = np.flatnonzero(enough.any(1))
            take = pa.array(hit)
            return pa.RecordBatch.from_arrays([part.column("g").take(take), part.column("c").take(take), pa.array([x.tobytes() for x in np.packbits(enough[hit], axis=1)], pa.binary())], ["g", "c", "bits"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= _ROWS:
                bucket = held.column("bucket").to_numpy()
                cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
                if cut:
                    yield done(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    bits = "g long, c long, bits binary"
    gather = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket", "c").mapInArrow(judge, bits)
    judged = gather(contexts.df.where(F.col("m") <= _GATHER).withColumn("bucket", F.col("g")))
    large = contexts.df.where(F.col("m") > _GATHER).drop("m")
    if not large.isEmpty():
        todo = large.withColumn("r", F.lit(0))
        for level in range(1, levels(least) + 1):
            rows, marks, todo = narrower(large, todo, level, least, keep)
            judged = judged.unionByName(gather(rows)).unionByName(marks)
            if todo is None:
                break
    judged = Stash(judged, "judged")
    contexts.drop()
    # what each class means for its members: every window (null), or those of the bits
    marks = judged.df.groupBy("g", "c").agg(F.collect_list("bits").alias("bits"))
    known = classes.df.join(marks, ["g", "c"], "left").where("n > 1 or bits is not null").select("g", "c", "n", "p", "bits")
    known = Stash(known, "known")
    member = here.df.join(known.df, ["g", "c"])
    if keep == "none":
        member = member.select("_a", "_b", "q", F.when(F.col("n") == 1, F.col("bits")).alias("bits"))
    else:
        first = F.col("p") == F.struct("_a", "_b", "q")
        member = member.select("_a", "_b", "q", F.when(first, F.coalesce("bits", F.array().cast("array<binary>"))).alias("bits"))
    return member.groupBy("_a", "_b").agg(F.collect_list(F.struct("q", "bits")).alias("own"))


def narrower(large: DataFrame, todo: DataFrame, level: int, least: int, keep: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Contexts of buckets that are too large (todo: large's columns and r, their range of the level before), dealt to the ranges of `level`:
    those to judge in buckets, the bits of those that are one class with others, and those whose buckets are still too large (None
    without any). A bucket is known by the hash h of gram, range and the bytes that the range's windows share; a class in it by the hash u of
    all that they cover. Which of a class goes on matters only where the first is kept."""
    place = ["_a", "_b", "q"] if keep != "none" else []

    def deal(batches):
        for batch in batches:
            row, part, core, cover = range_hashes(*_contexts(batch, least), batch.column("r").to_numpy(), level, least)
            take = pa.array(row)
            gram = batch.column("g").to_numpy()[row].view(np.uint64)
            core = mix(core + mix(gram + mix(part.astype(np.uint64), 7), 9))
            own = [batch.column(x).take(take) for x in ("g", "c", *place)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(part.astype(np.int16)), pa.array(core.view(np.int64)), pa.array(cover.view(np.int64))], ["g", "c", *place, "r", "h", "u"])

    dealt = Stash(todo.mapInArrow(deal, f"g long, c long, {''.join(f'{x} long, ' for x in place)}r short, h long, u long"), "dealt").df
    alike = stash(dealt.groupBy("h", "u").agg((F.count("*") > 1).alias("many"), F.min(F.struct(*place, "c", "g", "r")).alias("p")), "alike")
    marks = F.array(*(F.lit(x) for x in range_bits(least, level)))
    same = dealt.join(alike.where("many").select("h", "u", "p"), ["h", "u"])
    if keep != "none":
        same = same.where(F.col("p.c") != F.col("c"))
    same = same.select("g", "c", F.element_at(marks, F.col("r") + 1).alias("bits"))
    sizes = alike.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    first = stash(alike.join(sizes, "h").select("p.g", "p.c", F.col("p.r").cast("int").alias("r"), F.col("h").alias("bucket"), "m"), "first")
    over = first.where(F.col("m") > _GATHER)
    rows = large.join(first.where(F.col("m") <= _GATHER).select("g", "c", "bucket"), ["g", "c"])
    return rows, same, None if over.isEmpty() else large.join(over.select("g", "c", "r"), ["g", "c"])


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after another, and where each text begins and ends in them; a null has none."""
    text = text.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]] if len(text) else np.zeros(0, np.uint8)
    return data, at[:-1] - at[0], at[1:] - at[0]


def listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a column of lists, and the elements."""
    rows, inner = pc.list_parent_indices(column), pc.list_flatten(column)
    return rows.to_numpy().astype(np.int64), inner


def covered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: pa.Array, least: int) -> np.ndarray:
    """Which bytes of the texts (flat()'s) their windows cover. own: for each text its (q, bits), q an anchor and bits the places of its windows;
    null bits stand for every window with that anchor, and bits of places where the text has no window for nothing."""
    middle, edge = least - _GRAM, np.zeros(len(data) + 1, dtype=np.int32)
    owner, own = listed(own)
    q, bits = own.field("q").to_numpy(), own.field("bits")
    first, last = starts[owner], ends[owner] - least  # places of windows
    whole = bits.is_null().to_numpy(zero_copy_only=False)
    q = q + first
    np.add.at(edge, np.maximum(q[whole] - middle, first[whole]), 1)
    np.add.at(edge, np.minimum(q[whole], last[whole]) + least, -1)
    of, bits = listed(bits)
    for k in range(0, len(of), _MARKS):
        x, part = of[k : k + _MARKS], bits[k : k + _MARKS]
        packed = np.frombuffer(b"".join(part.to_pylist()), dtype=np.uint8).reshape(len(x), -1)
        grid = np.zeros((len(x), middle + 3), dtype=np.int8)  # with a place in front and behind
        grid[:, 1:-1] = np.unpackbits(packed, axis=1, count=middle + 1)
        at, place = (q[x] - middle)[:, None], np.arange(middle + 1)
        outer = np.flatnonzero((at[:, 0] < first[x]) | (q[x] > last[x]))
        grid[outer, 1:-1] *= (at[outer] + place >= first[x][outer, None]) & (at[outer] + place <= last[x][outer, None])
        step = np.diff(grid, axis=1)
        row, place = np.nonzero(step == 1)
        np.add.at(edge, at[row, 0] + place, 1)
        row, place = np.nonzero(step == -1)
        np.add.at(edge, at[row, 0] + place - 1 + least, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400, keep: str = "first", text: bool = True) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans (long), kept_sha256 (string) and, if asked, kept (binary): the bytes of each
    text that stay. Texts are UTF-8 bytes; a byte goes if a string of `least` bytes covers it that also starts
    elsewhere in any document, itself included: anywhere with keep='none', or at an earlier place (by id, then
    offset) with keep='first', so that the first copy stays. Strings are judged on the input.

    Null or empty text: no bytes. Null ids: a document like others, first in order. Repeated rows: each is a document, of which one goes
    through the search: those of at least `least` bytes lose everything, but for one of them with keep='first', which has the result of a single row. Very long texts: read whole, in
    blocks of 1 MB, with the result of one piece. Empty table: empty result. Other columns of docs are not read.
    """
    if least < _GRAM + 16:
        raise ValueError(f"least must be {_GRAM + 16} or more")
    kind = docs.schema[id_col].dataType
    ident = F.col(f"`{id_col}`").cast("long")
    body = F.col(f"`{text_col}`").cast("string")
    small_batches(docs.sparkSession)
    # a row is known by its id (for order) and the hash of both
    base = docs.select(F.coalesce(ident, F.lit(-(1 << 63))).alias("_a"), F.xxhash64(F.coalesce(ident.cast("string"), F.lit("")), body).alias("_b"), ident.alias("_id"), body.alias("_text"))
    base, times = once(base)
    found = spans(base, least, keep)

    def cut(batches):
        for batch in batches:
            data, starts, ends = flat(batch.column("_text"))
            mask = covered(data, starts, ends, batch.column("own"), least)
            begin = mask.copy()
            begin[1:] &= ~mask[:-1]
            some = starts < ends
            begin[starts[some]] = mask[starts[some]]
            gone, runs = np.zeros((2, len(starts)), dtype=np.int64)
            if some.any():
                gone[some], runs[some] = (np.add.reduceat(x, starts[some], dtype=np.int64) for x in (mask, begin))
            stay = ~mask
            kept = [(data[a:b][stay[a:b]] if n else data[a:b]).tobytes() for a, b, n in zip(starts.tolist(), ends.tolist(), gone.tolist(), strict=True)]
            cols = [ends - starts, gone, runs, [hashlib.sha256(x).hexdigest() for x in kept], kept if text else []]
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_a", "_b", "_id")), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))][: 8 if text else 7], ["_a", "_b", "_id", *names][: 8 if text else 7])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * text]
    out = base.join(found, ["_a", "_b"], "left").select("_a", "_b", "_id", "_text", "own")
    out = out.mapInArrow(cut, "_a long, _b long, _id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text)
    if times is not None:
        out = each_copy(out, times, names, least, keep)
    return out.select(F.col("_id").cast(kind).alias(id_col), *names)


def once(base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """base with one row for each (_a, _b), and those of which there are more with their number (times; None where there are none)."""
    times = Stash(base.groupBy("_a", "_b").agg(F.count("*").alias("times")).where("times > 1"), "repeated-rows").df
    if times.isEmpty():
        return base, None
    times = F.broadcast(times) if times.count() <= _BROADCAST else times
    several = base.join(times, ["_a", "_b"], "left_semi").groupBy("_a", "_b").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text"))
    return base.join(times, ["_a", "_b"], "left_anti").unionByName(stash(several, "rows-once")), times


def each_copy(out: DataFrame, times: DataFrame, names: list[str], least: int, keep: str) -> DataFrame:
    """out with as many rows of one id and text as there were. All of `least` bytes or more repeat each other as a whole: they lose everything,
    but for one where the first is kept."""
    each = out.join(times, ["_a", "_b"], "left").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1)))))
    gone = F.col("times").isNotNull() & (F.col("n_bytes") >= least) & ((F.col("_n") > 1) | F.lit(keep == "none"))
    nothing = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept": F.lit(b"")}
    return each.withColumns({c: F.when(gone, x).otherwise(F.col(c)) for c, x in nothing.items() if c in names})


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), keep="none", text=False)
