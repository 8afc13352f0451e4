"""Line dedup: drop lines that many documents share.

Lines are exploded, normalised and hashed; a hash counts the distinct documents that hold it; lines whose
hash reaches the threshold go from every document but one; what stays is reassembled by position. All of
it is DataFrame expressions. The text is shuffled once, for the reassembly; the counting moves 16 bytes of
hash and an id for each line, pre-aggregated before each shuffle, so that a line that a third of all
documents hold is a few partial rows a task. Frequent lines are a written table, and the join that finds
their places deals both sides itself, so that adaptive execution splits a hot line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE_CHARS, lower_ascii, rest_of, stash, table


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with text_col replaced by the lines that stay, and n_lines and n_dropped (long) added.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    min_chars code points found in at least min_docs documents lose all their lines except in the largest
    id that holds them. Keys are compared by 128 bits of hash.

    Null or empty text: one empty line, returned as ''. Null ids: the row stays as it is and isn't counted.
    Repeated rows: rows of one id count as one document, and each row loses and keeps its lines alike.
    Very long texts: read whole, a row for each line. Empty table: empty result. Columns of docs named n_lines or n_dropped are replaced; all others stay.
    """
    others = rest_of(docs, text_col, "n_lines", "n_dropped")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(
        F.struct(*others).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_t"),
        F.split(text, "\n", -1).alias("_lines"),
    )

    def key(line):
        # too short before trimming is too short after it
        k = lower_ascii(F.trim(line, F.lit(SPACE_CHARS)))
        return F.when(F.char_length(line) >= min_chars, F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))

    seen = (
        base.where(F.col("_id").isNotNull())
        .select("_id", "_t", F.posexplode(F.transform("_lines", key)).alias("_pos", "_key"))
        .where(F.col("_key").isNotNull())
        .select("_id", "_t", "_pos", F.col("_key.a").alias("_a"), F.col("_key.b").alias("_b"))
    )
    seen = stash(seen, "lines")
    frequent = (
        seen.groupBy("_a", "_b").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keep"))
        .where(F.col("_n") >= min_docs).select("_a", "_b", "_keep")
    )
    frequent = stash(frequent, "frequent-lines")
    drops = (
        seen.join(frequent, ["_a", "_b"]).where(F.col("_id") != F.col("_keep"))
        .groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_drop"))
    )
    joined = base.join(drops, ["_id", "_t"], "left")
    n = F.size("_lines")
    # array_except hashes, so this is linear; base carries the split lines, so each is looked up in O(1)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_drop")), lambda i: F.get("_lines", i))
    kept = F.array_join(F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(stay), "\n")
    out = joined.select("_row.*", kept.alias(text_col), n.cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[f"`{c.replace('`', '``')}`" for c in order], "n_lines", "n_dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.line, u.pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS pos) u
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.doc_id, pos, line, (frequent.k IS NOT NULL AND keyed.doc_id <> keep) AS gone
  FROM keyed LEFT JOIN frequent ON keyed.k = frequent.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
