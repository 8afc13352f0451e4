"""Periodic run detection: where a text's words repeat themselves at once, and the text with each run cut to its first period.

Every run is covered by windows of half of `least` words that are there twice in the text, so that one pass over hashes
leaves, of most texts, nothing to look at; what it leaves, stretches of words, goes through `runs`. A text is one task's work, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import words
from palimpsest.llm.common import SPACE, computed_once, rest_of, table
from palimpsest.llm.packing import small_batches
from palimpsest.llm.runs import runs
from palimpsest.llm.shingles import mix, pieces

_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def repeated(h: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(text number, first word, end) of the stretches that windows of `width` words cover of which the text has two or more."""
    n = len(h) - width + 1
    if n < 2:
        return
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    of = words.Stretches(h, 41)
    place = np.flatnonzero(text[:n] == text[width - 1 :])
    key = mix(of(place, place + width) + text[place].astype(np.uint64), 42)
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    twice = np.zeros(len(place), dtype=bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    edge = np.zeros(len(h) + 1, dtype=np.int32)
    np.add.at(edge, place[twice], 1)
    np.add.at(edge, place[twice] + width, -1)
    held = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    # stretches of neighbouring texts stay apart
    begin = np.flatnonzero(held[1:-1] & (~held[:-2] | np.concatenate([[True], text[1:] != text[:-1]])))
    stop = np.flatnonzero(held[1:-1] & (~held[2:] | np.concatenate([text[1:] != text[:-1], [True]]))) + 1
    yield from zip(text[begin].tolist(), (begin - at[text[begin]]).tolist(), (stop - at[text[begin]]).tolist(), strict=True)


def text_runs(texts: list[bytes], least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of at least `least` words of each text, in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for own, h, at in words.batches(texts):
        for k, first, end in repeated(h, at, least // 2):
            if end - first >= least:
                letters = np.unique(h[at[k] + first : at[k] + end], return_inverse=True)[1].tolist()
                out[own[k]] += [(first + s, n, p) for s, n, p in runs(letters, least)]
    return out


def collapse(text: bytes, own: list[tuple[int, int, int]]) -> bytes:
    """The words of a text joined by one space, without those that a run holds after its first period."""
    parts = [x.split() for x in pieces(text)]
    if own:
        gone = np.zeros(sum(map(len, parts)) + 1, dtype=np.int64)
        for start, n, p in own:
            gone[start + p] += 1
            gone[start + n] -= 1
        stay, at = (np.cumsum(gone) == 0).tolist(), 0
        for k, x in enumerate(parts):
            parts[k] = [w for w, s in zip(x, stay[at : at + len(x)], strict=True) if s]
            at += len(x)
    return b" ".join(b" ".join(x) for x in parts if x)


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """docs with runs, an array of (start, length, period) in order, and collapsed, a string. Words are runs of characters without space and code
    points 9 to 13, numbered from 0. A run is a stretch of words with smallest period q, at least `least` words and 2 * q long, that no
    neighbouring word extends; collapsed are the words that no run holds after its first q, joined by one space.

    Null, empty or wordless text: no runs, '' collapsed. Repeated rows and null ids: each row by itself. Very long texts: whole; words are
    hashed in blocks, and memory beyond the text goes with its longest repetitive stretch, by some 500 bytes a word. Empty table: empty
    result. Columns of docs named runs or collapsed are replaced; all others stay.
    """
    if least < 4:
        raise ValueError("least must be 4 or more")
    small_batches(docs.sparkSession)
    others = rest_of(docs, "runs", "collapsed")
    kind = docs.select(F.struct(*others).alias("_row")).schema["_row"].dataType

    def find(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("_text")]
            found = text_runs(texts, least)
            shape = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
            rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found], shape)
            kept = pa.array([collapse(t, own).decode() for t, own in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), rows, kept], ["_row", "runs", "collapsed"])

    schema = T.StructType([T.StructField("_row", kind), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    out = docs.select(F.struct(*others).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(find, schema)
    return out.select("_row.*", "runs", "collapsed")


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and the text of documents, in one of ten of which, by the checksum of its id, the words from some place on repeat what begins
    there. A null id: the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    text = F.col("text").cast("string")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = F.filter(F.split(F.when(chosen, text), SPACE + "+"), lambda w: w != "")
    rows = computed_once(docs.select("doc_id", text.alias("text"), g.alias("_g")), {"_words": split})
    n = F.size("_words")
    rows = computed_once(rows, {"_a": F.when(n > 0, F.col("_g") % n)})
    rows = computed_once(rows, {"_p": 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))})
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", source(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(n > 0, tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_tails(table(spark, sf_dir, "documents")))
    best = F.element_at(F.array_sort("runs", lambda a, b: (
        F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1))
        .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["period"] < b["period"], -1).otherwise(1)
    )), 1)
    number: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    best = F.when(F.size("runs") > 0, best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(number, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
