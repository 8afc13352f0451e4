"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights and packing, over documents.

Each stage takes all that the one before kept and calls an operator of palimpsest.llm. All but the last return the columns of its input as they
are, but for the text that line dedup shortens and n_chars: columns that a stage has no use for travel in one struct, out of the operator's
sight, so that none of their names clashes with what it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, mixing, near_dup, packing, quality
from palimpsest.llm.common import shared_path, table

_OTHERS = "_pipeline_others"


def _quoted(c: str) -> str:
    return f"`{c.replace('`', '``')}`"


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """docs with the used columns as they are and all others in one, and the columns by which docs' own come back from what an operator makes of it."""
    own = [c for c in docs.columns if c.lower() in used]
    others = [c for c in docs.columns if c not in own]
    name = _OTHERS
    while name in own:
        name += "_"
    # numbered fields, as names of columns may differ in case alone or hold dots
    struct = F.struct(*(F.col(_quoted(c)).alias(f"c{k}") for k, c in enumerate(others))) if others else F.lit(None).cast("string")
    back = [F.col(_quoted(c)) if c in own else F.col(f"{name}.c{others.index(c)}").alias(c) for c in docs.columns]
    return docs.select(*map(_quoted, own), struct.alias(name)), back


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base conditions nor the learned rules reject. The rules are learned from labels' quality.

    Null, empty or wordless text: rejected, as fewer than 50 words. Null ids and repeated rows: judged like any row. Very long texts: read
    whole. Empty tables: empty result; without labels, the base conditions alone. Columns with clashing names stay.
    """
    rules = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, back = apart(docs, "doc_id", "text")
    return quality.quality_rules(rows, rules).where("kept").select(*back)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of at least 20 characters that 3 or more of them share, but for one; n_chars follows.

    Null text: becomes ''. Null ids: the row stays as it is and isn't counted. Repeated rows: one document, each loses and keeps its lines alike.
    Very long texts: read whole. Empty table: empty result. Columns with clashing names stay.
    """
    rows, back = apart(docs, "doc_id", "text")
    out = line_dedup.line_dedup(rows).select(*back)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of similarity 0.8 or more.

    Null, empty or wordless text, or a null id: stays, linked with nothing. Repeated rows of an id: one document, which stay or go together.
    Very long texts: read whole. Empty table: empty result. Columns with clashing names stay.
    """
    groups = near_dup.near_dup(docs.select("doc_id", "text"), percent=80)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(_quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of whole documents whose tokens, counted as words, meet the target shares of sources, languages and topics.

    Null, empty or wordless text: no tokens; stays by its cell's chance, or always where the cell has no tokens. Null ids: all alike by
    hash. Repeated rows: kept alike. Very long texts: read whole. Empty table: empty result. Columns with clashing names stay.
    """
    rows, back = apart(docs, "doc_id", "text", *mixing.TARGETS)
    return mixing.mix_sources(rows).where("kept").select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens, counted by the byte-pair vocabulary.

    Null or empty text: the end id alone. Null ids and repeated rows: each row is a document of its own. Very long texts: as many pieces as they
    take. Empty table: empty result. Other columns aren't returned.
    """
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]
#: Learned rules, near-dedup, raking and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each one's result written and reread; materialize.drop_all removes what is left of them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
