"""Repeated passages, found by anchors at the positions of a difference cover.

A difference cover of a period holds, for every distance, two positions that far apart modulo the period. So whatever the offsets of two
equal passages in their documents, within the first `period` words both have a position of the cover at the same place of the passage.
A window of `width` words is therefore known to repeat by a gram of `width - period + 1` words at such a place, its anchor:

1. One pass hashes the grams that begin at positions of the cover, about a fifth of all, and counts in which documents they are: a gram
   of one document alone anchors nothing. The pass is made again for the anchors of the other grams, a small part of all.
2. Anchors are extended. Those of the same gram and the same words around it, as far as windows with this anchor reach, are a
   class: all its windows are in all its documents, so that all but the smallest id lose them. A text copied to a third of all documents
   is a few classes, whatever its copies.
3. Of grams with several classes, one place of each class is read again for hashes of its windows. A window reaches half of the surplus
   words to the left of its gram or to the right, so hashes of these halves come first, and only windows of halves that two
   documents share are compared: a window goes if a class with a smaller id has it at the same place.
4. What each anchor says goes back to its documents, where the windows are united.

Counts are of pairs of numbers, pre-aggregated before every shuffle; no step makes pairs of documents. Texts move only where
they hold something repeated. Equal passages are told by 128 bits of hash (gram and words around it, gram and window).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import words
from palimpsest.llm.common import Stash, table
from palimpsest.llm.packing import small_batches
from palimpsest.llm.shingles import mix, pieces

#: Perfect difference sets, in which every distance but 0 occurs exactly once.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 6, 15, 22, 26, 45, 55)}
_WORDS = 1 << 17  # of a long text, anchored at a time
_BROADCAST = 1_000_000  # ids, about 50 MB as a hash table
_FETCH = 4096  # rows that leave a task together


def period(width: int) -> int:
    """The longest period that leaves grams of two fifths of a window."""
    fits = [p for p in COVERS if 5 * (width - p + 1) >= 2 * width]
    if not fits:
        raise ValueError("width must be 4 or more")
    return max(fits)


def _anchored(h: np.ndarray, at: np.ndarray, width: int, shift: int = 0):
    """(text number, place, gram hash, hash of the words around) of the anchors of texts whose words are h[at[k] : at[k + 1]]. shift: how
    many words of the text come before these, of which the anchors' windows take in none."""
    p = period(width)
    gram, counts = width - p + 1, np.diff(at)
    at_cover = np.zeros(p, dtype=bool)
    at_cover[list(COVERS[p])] = True
    first, end, every = np.repeat(at[:-1], counts), np.repeat(at[1:], counts), np.arange(len(h))
    q = np.flatnonzero(at_cover[(every - first + shift) % p] & (every + gram <= end) & (end - first >= width) & (every - (p - 1) + width <= end))
    first, end = first[q], end[q]
    of = words.Stretches(h, 35)
    lo, hi = np.maximum(q - (p - 1), first), np.minimum(q, end - width) + width
    around = mix(of(lo, hi) + mix(((q - lo) * (4 * width) + hi - q).astype(np.uint64), 36))
    return np.searchsorted(at, q, "right") - 1, q - first + shift, of(q, q + gram).view(np.int64), around.view(np.int64)


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text number, place in words, gram hash, hash of the words around) of all anchors of the texts."""
    parts = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    p = period(width)
    for own, h, at in words.batches(texts):
        for lo in range(0, max(len(h), 1), _WORDS) if len(own) == 1 else [0]:
            if len(own) > 1 or len(h) <= _WORDS:
                k, q, g, c = _anchored(h, at, width)
            else:
                shift = max(lo - (p - 1), 0)
                part = h[shift : lo + _WORDS + width]
                k, q, g, c = _anchored(part, np.array([0, len(part)]), width, shift)
                inner = (q >= lo) & (q < lo + _WORDS)
                k, q, g, c = k[inner], q[inner], g[inner], c[inner]
            parts.append((own[k], q, g, c))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def halves(text: bytes, places: np.ndarray, width: int):
    """For each anchor at a place, its windows on either side, as (number of the place, hash of the half that all windows of the side share, distances
    of the windows' starts to the left of the gram, from the smallest, hashes of the windows): the left side's windows begin at least half of the
    surplus to the left."""
    p = period(width)
    gram, half = width - p + 1, p // 2
    (_, h, _), *_ = words.batches([text])
    n, of = len(h), words.Stretches(h, 37)
    low, high = np.maximum(places - (n - width), 0), np.minimum(places, p - 1)
    for left, a, b in ((True, np.maximum(low, half), high), (False, low, np.minimum(high, half - 1))):
        own = np.flatnonzero(a <= b)
        if not len(own):
            continue
        q = places[own]
        shared = mix(of(q - half, q + gram), 38) if left else mix(of(q, q + width - half + 1), 39)
        sizes = (b - a + 1)[own]
        k = np.repeat(a[own], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = np.repeat(q, sizes) - k
        hashes = mix(of(start, start + width) + k.astype(np.uint64), 40).view(np.int64)
        for number, s, first, one in zip(own.tolist(), shared.view(np.int64).tolist(), a[own].tolist(), np.split(hashes, np.cumsum(sizes)[:-1]), strict=True):
            yield number, s, first, one


def spans(docs: DataFrame, width: int) -> DataFrame:
    """(_a, _b, own) of the documents that lose something, of docs' (_a, _b, _text) with no null _a: own has the places of anchors, and which of
    their windows go: all (-1), or those of the bits, by the distance of their start."""

    def find(short: bool):
        names = ["g", "_a"] if short else ["g", "c", "_a", "_b", "q"]

        def run(batches):
            for batch in batches:
                k, q, g, c = anchors([(t.as_py() or "").encode() for t in batch.column("_text")], width)
                take = pa.array(k)
                cols = {"g": pa.array(g), "c": pa.array(c), "q": pa.array(q), "_a": batch.column("_a").take(take), **({} if short else {"_b": batch.column("_b").take(take)})}
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

        return docs.select("_a", *([] if short else ["_b"]), "_text").mapInArrow(run, ", ".join(f"{n} long" for n in names))

    several = F.min("_a") < F.max("_a")  # documents hold it
    twice = Stash(find(True).groupBy("g").agg(several.alias("s")).where("s").select("g"), "grams")
    here = Stash(find(False).join(twice.df, "g", "left_semi"), "repeated")
    classes = Stash(here.df.groupBy("g", "c").agg(F.min(F.struct("_a", "_b", "q")).alias("p"), F.max("_a").alias("last")), "anchor-classes")
    # classes of a gram matter to each other if their smallest ids differ
    groups = classes.df.groupBy("g").agg((F.min("p._a") < F.max("p._a")).alias("s")).where("s").select("g")
    need = classes.df.join(groups, "g").groupBy("p._a", "p._b").agg(F.collect_list(F.struct("g", "c", "p.q")).alias("own"))
    need = Stash(need, "to-extend")

    def extend(batches):
        kinds, names = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int64())], ["g", "c", "_a", "s", "k", "h"]
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            rows = []
            for a, text, own in zip(batch.column("_a").to_pylist(), batch.column("_text"), batch.column("own").to_pylist(), strict=True):
                for number, s, k, hashes in halves((text.as_py() or "").encode(), np.array([x["q"] for x in own], dtype=np.int64), width):
                    rows.append((own[number]["g"], own[number]["c"], a, s, k, hashes))
                    if len(rows) >= _FETCH:
                        yield done(rows)
                        rows = []
            if rows:
                yield done(rows)

    sides = with_lists(docs, need.df, "inner").mapInArrow(extend, "g long, c long, _a long, s long, k int, h array<long>")
    sides = Stash(sides, "halves")
    shared = sides.df.groupBy("g", "s").agg(several.alias("n")).where("n").select("g", "s")
    windows = sides.df.join(shared, ["g", "s"], "left_semi").select("g", "c", "_a", "k", F.posexplode("h").alias("i", "h"))
    windows = Stash(windows.select("g", "c", "_a", F.col("h"), (F.col("k") + F.col("i")).cast("byte").alias("k")), "windows")
    first = windows.df.groupBy("g", "h").agg(F.min("_a").alias("first"), F.max("_a").alias("last")).where("first < last").select("g", "h", "first")
    bits = windows.df.join(first, ["g", "h"]).where("_a > first").groupBy("g", "c").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
    known = classes.df.join(bits, ["g", "c"], "left").where("bits is not null or last > p._a").select("g", "c", F.col("p._a").alias("first"), "bits")
    known = Stash(known, "known")
    member = here.df.join(known.df, ["g", "c"]).select("_a", "_b", "q", F.when(F.col("_a") > F.col("first"), F.lit(-1).cast("long")).otherwise(F.col("bits")).alias("bits"))
    lists = Stash(member.where("bits is not null").groupBy("_a", "_b").agg(F.collect_set(F.struct("q", "bits")).alias("own")), "removals")
    for x in (twice, here, classes, need, sides, windows, known):
        x.drop()
    return lists.df


def with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs joined (inner or left) with the lists of their own; those without one stay where they are, if the ids of the others are few."""
    key = ["_a", "_b"]
    if lists.count() > _BROADCAST:
        return docs.join(lists, key, how)
    ids = F.broadcast(lists.select(*key))
    out = docs.join(ids, key, "left_semi").join(lists, key)
    return out if how == "inner" else out.unionByName(docs.join(ids, key, "left_anti"), allowMissingColumns=True)


def removed(n: int, own: list[dict], width: int) -> np.ndarray:
    """Which of n words the windows of the anchors cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    q, bits = np.array([x["q"] for x in own], dtype=np.int64), np.array([x["bits"] for x in own], dtype=np.int64)
    whole = q[bits == -1]
    np.add.at(edge, np.maximum(whole - (period(width) - 1), 0), 1)
    np.add.at(edge, np.minimum(whole, n - width) + width, -1)
    for k in range(period(width)):
        start = q[(bits != -1) & (bits >> k & 1 == 1)] - k
        np.add.at(edge, start, 1)
        np.add.at(edge, start + width, -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, text: bool = True) -> DataFrame:
    """id_col, n_words, n_removed (long), kept_sha256 (string) and, if asked, kept (string): the words of each text that stay, joined by one
    space. A word, a run without space and code points 9 to 13, goes if a window of `width` words covers it whose words also follow each
    other in a document of a smaller id. Windows are judged on the input.

    Null, empty or wordless text: no words. Null ids: neither smaller nor larger than others, the row keeps all words. Repeated rows:
    rows of one id are one document, which takes nothing from itself; each is returned, those of one text alike. Repeats
    within a document stay. Very long texts: read whole, in blocks, with the result of one piece. Empty table: empty result. Other
    columns of docs are not read.
    """
    period(width)
    kind = docs.schema[id_col].dataType
    body = F.col(f"`{text_col}`").cast("string")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("_a"), F.xxhash64(body).alias("_b"), body.alias("_text"))
    lists = spans(base.where("_a is not null"), width)
    names = ["n_words", "n_removed", "kept_sha256", *["kept"] * text]

    def cut(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for t, own in zip(batch.column("_text"), batch.column("own").to_pylist(), strict=True):
                parts = [x.split() for x in pieces((t.as_py() or "").encode())]
                n = sum(map(len, parts))
                gone, at = 0, 0
                if own:
                    mask = removed(n, own, width)
                    gone = int(mask.sum())
                    stay = (~mask).tolist()
                    for k, x in enumerate(parts):
                        parts[k] = [w for w, s in zip(x, stay[at : at + len(x)], strict=True) if s]
                        at += len(x)
                kept = b" ".join(b" ".join(x) for x in parts if x)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("_a"), *(pa.array(c, t) for c, t in zip(cols[: len(names)], kinds, strict=False))], ["_a", *names])

    schema = "_a long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text
    out = with_lists(base, lists, "left").select("_a", "_text", "own").mapInArrow(cut, schema)
    return out.select(F.col("_a").cast(kind).alias(id_col), *names)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), text=False)
