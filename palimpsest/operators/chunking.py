"""Chunks of transcripts: prompts, assistant texts in token windows, and tool calls with their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.functions import ids
from palimpsest.functions import text as tx
from palimpsest.functions.tokens import Bpe

WINDOW, OVERLAP, RESULT_CHARS = 400, 50, 4000


def token_windows(text: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of texts: windows of size words that overlap; a text of at most size words as it is."""
    own = tx.words(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < F.size(own)))
    return F.when(F.size(own) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(own, s + 1, size), " ")))


def text_of(blocks: Column) -> Column:
    """The text blocks, joined; null without any."""
    t = F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: b["text"]), "\n")
    return F.when(t != "", t)


def chunk(records: DataFrame, tokens: Bpe | None = None) -> DataFrame:
    """chunk_id, session_id, project_id, turn_index, sub_index, role, kind, text, token_count, redactions, started_at,
    tool_name and tool_input of records (session_id, project_id, turn_index, ty, uuid, parent_uuid, timestamp, blocks,
    attachment_kind, attachment_text). The k-th tool call of a message takes the k-th result attached to it. tokens: the vocabulary
    that windows and counts go by; words without one."""
    cut = (lambda c: tokens.windows(c, WINDOW, OVERLAP)) if tokens else token_windows
    count = tokens.count if tokens else lambda c: F.size(tx.words(c))
    keep = ["session_id", "project_id", "turn_index", "timestamp"]
    prompts = records.where("ty = 'user'").withColumn("t", text_of(F.col("blocks"))).where("t is not null")
    prompts = prompts.select(*keep, F.lit(0).alias("block"), F.lit(0).alias("piece"), F.lit("user").alias("role"), F.when(tx.is_command("t"), "command_message").otherwise("user_prompt").alias("kind"), F.col("t").alias("text"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_input"))
    parts = records.where("ty = 'assistant'").select(*keep, "uuid", F.posexplode("blocks").alias("block", "b"))
    texts = parts.where("b.kind = 'text'").select(*keep, "block", F.posexplode(cut(F.col("b.text"))).alias("piece", "text"))
    texts = texts.select(*keep, "block", "piece", F.lit("assistant").alias("role"), F.lit("assistant_text").alias("kind"), "text", F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_input"))
    calls = parts.where("b.kind = 'tool_use'").withColumn("k", F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy("block")))
    results = records.where("ty = 'attachment' and attachment_kind = 'tool-result' and attachment_text is not null").select("session_id", F.col("parent_uuid").alias("uuid"), F.row_number().over(Window.partitionBy("session_id", "parent_uuid").orderBy("turn_index")).alias("k"), F.col("attachment_text").alias("result"))
    calls = calls.join(results, ["session_id", "uuid", "k"], "left")
    said = F.concat(F.lit("Tool call: "), F.col("b.name"), F.lit("\nInput: "), F.col("b.input_preview"), F.when(F.col("result").isNotNull(), F.concat(F.lit("\nResult:\n"), tx.truncate("result", RESULT_CHARS))).otherwise(""))
    calls = calls.select(*keep, "block", F.lit(0).alias("piece"), F.lit("tool_use").alias("role"), F.lit("tool_call").alias("kind"), said.alias("text"), F.col("b.name").alias("tool_name"), tx.redact(F.col("b.input_preview"))["text"].alias("tool_input"))
    every = prompts.unionByName(texts).unionByName(calls)
    sub = F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy("block", "piece")) - 1
    every = every.withColumn("sub_index", sub).withColumn("r", tx.redact("text"))
    return every.select(
        ids.chunk_id(F.col("session_id"), F.col("turn_index"), F.col("sub_index")).alias("chunk_id"), "session_id", "project_id", "turn_index", "sub_index", "role", "kind", F.col("r.text").alias("text"),
        count(F.col("r.text")).alias("token_count"), F.col("r.n").alias("redactions"), F.coalesce("timestamp", F.current_timestamp()).alias("started_at"), "tool_name", "tool_input",
    )
