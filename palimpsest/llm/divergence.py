"""Source divergence audit: how far the sources of a language are from each other, and by which terms each differs from its language.

Terms are counted by language and source before anything is shuffled. What a language keeps is sorted and cut into chunks, and a term's id is
its chunk and its place there, found by binary search in the chunk's sorted terms. Ids keep the order of terms, so that ties between
terms break by id. The sources of a language are dealt to blocks; a chunk's counts of a block's sources are counted by id into dense
vectors, from which sums of differences and the most frequent terms come. Tasks hold the vectors of a block and a chunk, or of two blocks
where pairs of sources meet, whatever there is of documents, terms or sources.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Stash, stash, table
from palimpsest.llm.packing import small_batches

SCALE, PRIOR = 1_000_000_000, 5
CHUNK = 4096  # terms of a vector
BLOCK = 64  # sources of a block, about
_HELD = 200_000  # terms counted in a task before their counts go on
#: Bytes of a term as they are, A-Z lower-cased, and all others as space: bytes beyond 127 are those of characters beyond 127.
_TERMS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, several rows for each; and one row with the term '' at least for each group."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def done():
            rows = [(*key, term, k, within[term]) for key, (n, within) in counts.items() for term, k in [(b"", 0), *n.items()]]
            counts.clear()
            for at in range(0, len(rows), 50_000):
                cols = zip(*rows[at : at + 50_000], strict=True)
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if t != pa.binary() else pa.array(c, t).cast(pa.string()) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for *key, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                found = (text.as_py() or "").encode().translate(_TERMS).split()
                n, within = counts.setdefault(tuple(key), (Counter(), Counter()))
                n.update(found)
                within.update(set(found))
            if sum(len(n) for n, _ in counts.values()) > _HELD:
                yield from done()
        yield from done()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def chunks(kept: DataFrame) -> DataFrame:
    """(lang, chunk, terms, totals) of kept (lang, term, n): sorted terms, in chunks whose numbers keep the order of terms."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, None

        def row(lang, terms, totals):
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number]), pa.array([terms], pa.list_(pa.string())), pa.array([totals], pa.list_(pa.int64()))], ["lang", "chunk", "terms", "totals"])

        for batch in batches:
            for lang, term, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "n")), strict=True):
                if held and (held[0] != lang or len(held[1]) == CHUNK):
                    yield row(*held)
                    number, held = number + 1, None
                held = held or (lang, [], [])
                held[1].append(term)
                held[2].append(n)
        if held:
            yield row(*held)

    return kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, chunk long, terms array<string>, totals array<long>")


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / whole), exactly, for whole numbers up to 9e15: three digits at a time."""
    out, rest = np.divmod(counts + PRIOR, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def _vectors(key, one: pa.Table, cells: pa.Table) -> pa.Table:
    """The vectors of a block's sources over a chunk, sums of differences of its pairs, and each source's first terms."""
    row = one.to_pylist()[0]
    terms = np.array([t.encode() for t in row["terms"]], dtype=object)
    own = sorted(row["sources"], key=lambda s: s["source"].encode())
    at = {s["source"]: k for k, s in enumerate(own)}
    counts = np.zeros((len(own), len(terms)), dtype=np.int64)
    if len(terms):
        ids = np.searchsorted(terms, np.array([t.encode() for t in cells.column("term").to_pylist()], dtype=object))
        group = np.array([at[s] for s in cells.column("source").to_pylist()], dtype=np.int64)
        counts = np.bincount(group * len(terms) + ids, weights=cells.column("n").to_numpy(), minlength=counts.size).astype(np.int64).reshape(counts.shape)
    v = row["n_terms"] * PRIOR
    p = shares(counts, np.array([[s["n"] + v] for s in own], dtype=np.int64)) if v else counts
    q = shares(np.array(row["totals"], dtype=np.int64), row["n"] + v) if v else counts[0]
    pairs = [{"a": own[i]["source"], "b": own[j]["source"], "value": x} for i in range(len(own) - 1) for j, x in enumerate(np.abs(p[i + 1 :] - p[i]).sum(1).tolist(), i + 1)]
    first = []
    for k, s in enumerate(own):
        more = np.flatnonzero((counts[k] > 0) & (p[k] > q))
        gap = p[k][more] - q[more]
        for i in np.lexsort((more, -gap))[: row["most"]].tolist():
            first.append({"source": s["source"], "place": int(more[i]), "item": terms[more[i]].decode(), "q": int(q[more[i]]), "value": int(gap[i])})
    out = {"lang": row["lang"], "chunk": row["chunk"], "block": row["block"], "sources": [s["source"] for s in own], "p": [x.tobytes() for x in p], "pairs": pairs, "first": first}
    return pa.Table.from_pylist([out], _ROW)


_ROW = pa.schema([
    ("lang", pa.string()), ("chunk", pa.int64()), ("block", pa.int32()), ("sources", pa.list_(pa.string())), ("p", pa.list_(pa.binary())), ("pairs", pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))),
    ("first", pa.list_(pa.struct([("source", pa.string()), ("place", pa.int32()), ("item", pa.string()), ("q", pa.int64()), ("value", pa.int64())]))),
])
_DDL = "lang string, chunk long, block int, sources array<string>, p array<binary>, pairs array<struct<a:string,b:string,value:long>>, first array<struct<source:string,place:int,item:string,q:long,value:long>>"


def _between(batches):
    """Sums of differences of the sources of two blocks over a chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            p = np.array([np.frombuffer(x, np.int64) for x in row["p"]])
            for a, x in zip(row["others"], row["o"], strict=True):
                value = np.abs(p - np.frombuffer(x, np.int64)).sum(1)
                kinds = [pa.string()] * 3 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([row["lang"]] * len(p), [a] * len(p), row["sources"], value), kinds, strict=True)], ["lang", "a", "b", "value"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, most: int = 50) -> DataFrame:
    """lang, source, part, item (string), value (long), rank (int), for each source of each language; all of it exact.

    Terms are runs of letters a-z, A-Z (lower-cased) and of characters beyond 127. A language keeps the terms that at least `least` of its documents
    hold; V is their number. Each of its sources, and the language as a whole, gives a kept term p = 1 + floor(1000000000 * (count + 5) / (N + 5 * V)),
    N being its occurrences of kept terms. part 'pair': for each other source of the language, the sum of |p - p'| over all kept terms (0 without
    any). part 'term': for the kept terms that the source has and gives more than the language, the `most` largest differences. Ranks go by
    value, largest first, then by the item's UTF-8 bytes.

    Null text, language or source: ''. Groups without terms: there, with a count of 0 for every term. Empty texts: documents without
    terms. Very long texts: whole. Null ids and repeated rows: ids aren't read, each row is a document. Ties: by the item. Empty table:
    empty result. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    text, lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source")))
    counts = term_counts(docs.select(lang, source, text)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = Stash(counts, "term-counts")
    kept = counts.df.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    dictionary = Stash(chunks(kept), "dictionary")
    places = dictionary.df.select("lang", "chunk", F.explode("terms").alias("term"))
    cells = Stash(counts.df.join(places, ["lang", "term"]).select("lang", "source", "term", "chunk", "n"), "cells")
    # groups, with their occurrences of kept terms, dealt to blocks
    groups = counts.df.where("term = ''").select("lang", "source").join(cells.df.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    blocks = groups.join(sizes, "lang").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "whole", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    blocks = stash(blocks, "groups")
    terms = dictionary.df.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    block = blocks.groupBy("lang", "block", "whole").agg(F.collect_list(F.struct("source", "n")).alias("sources")).join(terms, "lang", "left")
    # a language without kept terms has one chunk of none
    whole = block.join(dictionary.df, "lang", "left").select(
        "lang", F.coalesce("chunk", F.lit(-1).cast("long")).alias("chunk"), "block", "sources", F.col("whole").alias("n"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("totals", F.array().cast("array<long>")).alias("totals"), F.lit(most).alias("most"),
    )
    key = ["lang", "chunk", "block"]
    found = cells.df.join(blocks.select("lang", "source", "block"), ["lang", "source"]).select(*key, "source", "term", "n")
    whole, found = whole.toDF(*whole.columns), found.toDF(*found.columns)  # columns of their own
    vectors = stash(whole.groupBy(*key).cogroup(found.groupBy(*key)).applyInArrow(_vectors, _DDL), "vectors")
    for x in (counts, dictionary, cells):
        x.drop()
    pairs = vectors.select("lang", F.explode("pairs").alias("x")).select("lang", "x.a", "x.b", "x.value")
    if not vectors.where("block > 0").isEmpty():
        other = vectors.select("lang", "chunk", F.col("block").alias("other"), F.col("sources").alias("others"), F.col("p").alias("o"))
        met = vectors.join(other, ["lang", "chunk"]).where("other < block").select("lang", "sources", "p", "others", "o")
        pairs = pairs.unionByName(met.mapInArrow(_between, "lang string, a string, b string, value long"))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    by = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item")))
    first = vectors.select("lang", "chunk", F.explode("first").alias("x")).select("lang", "x.source", F.lit("term").alias("part"), "x.item", "x.value", "chunk", "x.place")
    first = first.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "chunk", "place"))).drop("chunk", "place")
    return pairs.unionByName(first.where(F.col("rank") <= most))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT row_no, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30
), size AS (
  SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), sums AS (
  SELECT lang, source, sum(n) AS whole FROM counted GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.whole, 0) + 5 * z.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (z.whole + 5 * z.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN size z ON g.lang = z.lang
  LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN counted c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), gaps AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON a.lang = g.lang AND a.source = g.source AND b.source = g.item
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50
"""
