"""Session, project and usage analytics over records, sessions and recall hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.functions import ids
from palimpsest.functions import text as tx

# Record types of transcripts.
KNOWN_TYPES = ("user", "assistant", "system", "attachment", "tool-result", "file-history-snapshot", "queue-operation", "ai-title", "agent-name", "last-prompt", "file-missing", "file-error", "permission-mode")
# How long a session may pause, what stands where a transcript is cut, and by how much a pause weighs.
CONTINUES_MINUTES, CUT_MARK, PAUSE_WEIGHT = 30, "[…transcript truncated at max_chars…]", 0.75


def last_filled(c: str, order: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order)))


def rollup(records: DataFrame) -> DataFrame:
    """A row for each session_id of records (line_no, ty, timestamp, cwd, git_branch, ai_title, prompt_text)."""
    first = F.min_by("prompt_text", F.when((F.col("ty") == "user") & F.col("prompt_text").isNotNull(), F.col("line_no")))
    return records.groupBy("session_id", "project_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count_if(F.col("ty") == "user").alias("user_count"), F.count_if(F.col("ty") == "assistant").alias("assistant_count"),
        F.count_if(F.col("ty").isin("user", "assistant")).alias("message_count"), last_filled("cwd", "line_no").alias("cwd"), last_filled("git_branch", "line_no").alias("git_branch"),
        F.max_by("ai_title", F.when(F.col("ai_title").isNotNull(), F.col("line_no"))).alias("ai_title"), tx.truncate(tx.redact(first)["text"], 280).alias("first_prompt"),
    )


def usage(records: DataFrame) -> DataFrame:
    """Token sums of assistant records by session and model."""
    sums = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return records.where("ty = 'assistant' and model is not null").groupBy("session_id", "model").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums))


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """The roll-ups of sessions (old: all or more of rollup()'s columns) and of the records that follow (new), as of all records together."""
    both = new.alias("n").join(old.alias("o"), F.col("n.session_id") == F.col("o.session_id"), "full")
    late = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    early = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    total = lambda c: (F.coalesce(F.col(f"n.{c}"), F.lit(0)) + F.coalesce(F.col(f"o.{c}"), F.lit(0))).alias(c)
    return both.select(
        late("session_id"), late("project_id"), F.least("n.started_at", "o.started_at").alias("started_at"), F.greatest("n.ended_at", "o.ended_at").alias("ended_at"), *map(total, ("user_count", "assistant_count", "message_count")),
        *map(late, ("cwd", "git_branch", "ai_title")), early("first_prompt"),
    )


def merge_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """The token sums of old and new, as usage() gives them."""
    sums = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return old.select(*new.columns).unionByName(new).groupBy("session_id", "model").agg(*(F.sum(c).alias(c) for c in sums))


def type_histogram(records: DataFrame, unknown: bool = False) -> DataFrame:
    """Records by type; with unknown, only types not in KNOWN_TYPES and '<missing>'."""
    missing = F.col("ty").isNull() | (F.col("ty") == "")
    if unknown:
        records = records.where(missing | ~F.col("ty").isin(*KNOWN_TYPES)).withColumn("ty", F.when(missing, "<missing>").otherwise(F.col("ty")))
    else:
        records = records.where(~missing)
    return records.groupBy(F.col("ty").alias("type")).agg(F.count("*").alias("n"))


def project_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project_id").agg(F.count("*").alias("session_count"), F.max("ended_at").alias("last_seen"))


def recent_project(sessions: DataFrame) -> DataFrame:
    """The project of the latest session; of several, the smallest."""
    return project_summary(sessions).orderBy(F.desc_nulls_last("last_seen"), "project_id").limit(1)


def project_cwd(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project_id").agg(last_filled("cwd", "started_at").alias("cwd"))


def recent(sessions: DataFrame, project: str | None = None, limit: int = 50) -> DataFrame:
    if project is not None:
        sessions = sessions.where(F.col("project_id") == project)
    return sessions.orderBy(F.desc_nulls_last("ended_at"), "session_id").limit(min(max(limit, 1), 1000))


def unsummarized(sessions: DataFrame, project: str | None = None, limit: int = 20) -> DataFrame:
    return recent(sessions.where("summary is null and not is_sidechain and message_count >= 4"), project, min(max(limit, 1), 100))


def titled(sessions: DataFrame, part: str) -> DataFrame:
    """Sessions whose title or first prompt has part in it, newest first."""
    low = part.lower()
    return sessions.where(F.lower(F.coalesce("ai_title", F.lit(""))).contains(low) | F.lower(F.coalesce("first_prompt", F.lit(""))).contains(low)).orderBy(F.desc_nulls_last("ended_at"), "session_id")


def following(sessions: DataFrame, by: list[str]) -> DataFrame:
    """sessions with b and next, the session_id and start of the one that follows it in its group, by started_at and session_id; null for the last.
    An hour's sessions of a group are a task's work, and the last of an hour gets the first of the next hour that has any, from a row for each hour,
    so that a group of any number of sessions spreads over tasks."""
    rows = sessions.withColumn("_hour", F.date_trunc("hour", "started_at"))
    within = Window.partitionBy(*by, "_hour").orderBy("started_at", "session_id")
    rows = rows.withColumn("_b", F.lead("session_id").over(within)).withColumn("_next", F.lead("started_at").over(within))
    own = [f"_by{k}" for k in range(len(by))]
    first = sessions.groupBy(*(F.col(c).alias(n) for c, n in zip(by, own, strict=True)), F.date_trunc("hour", "started_at").alias("_at")).agg(F.min(F.struct("started_at", "session_id")).alias("_f"))
    first = first.withColumn("_after", F.lead("_f").over(Window.partitionBy(*own).orderBy("_at")))
    same = F.col("_hour") == F.col("_at")
    for c, n in zip(by, own, strict=True):
        same &= F.col(c).eqNullSafe(F.col(n))
    out = rows.join(first, same)
    return out.select(*sessions.columns, F.coalesce("_b", "_after.session_id").alias("b"), F.coalesce("_next", "_after.started_at").alias("next"))


def continuations(sessions: DataFrame) -> DataFrame:
    """Edges between sessions of a project that follow each other within 30 minutes; the nearer the heavier."""
    rows = sessions.where("not is_sidechain and started_at is not null and ended_at is not null").select("project_id", "session_id", "started_at", "ended_at")
    pairs = following(rows, ["project_id"]).withColumnRenamed("session_id", "a")
    gap = F.expr("timestampdiff(MINUTE, ended_at, next)")
    pairs = pairs.where(F.col("b").isNotNull()).withColumn("gap_minutes", gap).where(F.col("gap_minutes").between(0, CONTINUES_MINUTES))
    return pairs.select(
        ids.edge_id(F.lit("session-continuation"), F.col("a"), F.col("b")).alias("edge_id"), "project_id", "a", "b", F.col("gap_minutes").cast("long").alias("gap_minutes"),
        (1 - PAUSE_WEIGHT * F.col("gap_minutes") / CONTINUES_MINUTES).alias("weight"), F.format_string("resumed %dm after the previous session ended", F.col("gap_minutes")).alias("evidence"),
    )


def hot_chunks(hits: DataFrame, chunks: DataFrame, project: str | None, since, least: int = 3, limit: int = 12) -> DataFrame:
    """Chunks that several distinct sessions recalled, other than through the hook."""
    rows = hits.where((F.col("source") != "hook") & (F.col("hit_at") >= F.lit(since)))
    if project is not None:
        rows = rows.where(F.col("project_id") == project)
    counts = rows.groupBy("chunk_id").agg(F.countDistinct("session_id").alias("distinct_sessions")).where(F.col("distinct_sessions") >= least)
    return counts.join(chunks.select("chunk_id", "text"), "chunk_id").orderBy(F.desc("distinct_sessions"), "chunk_id").limit(limit)


def transcript(chunks: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """A session's transcript: a line of role, tool and text for each chunk in order, cut before the first that doesn't fit."""
    tool = F.when(F.col("tool_name").isNotNull(), F.concat(F.lit(" ["), F.col("tool_name"), F.lit("]"))).otherwise("")
    w = Window.partitionBy("session_id").orderBy("turn_index", "sub_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.withColumn("line", F.concat(F.col("role"), tool, F.lit(": "), F.col("text"), F.lit("\n\n"))).withColumn("bytes", F.sum(F.octet_length("line")).over(w))
    fits = F.lit(True) if most_bytes is None else F.col("bytes") <= most_bytes
    parts = F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("turn_index", "sub_index", "line")))), lambda x: x["line"])
    cut = F.when(F.bool_or(~fits), F.lit(CUT_MARK)).otherwise("")
    return rows.groupBy("session_id").agg(F.concat(F.array_join(parts, ""), cut).alias("transcript"))


def render(chunks: DataFrame) -> DataFrame:
    """A session's chunks as a prompt for a summary."""
    label = F.when((F.col("role") == "tool_use") & F.col("tool_name").isNotNull(), F.concat(F.lit("[tool_use: "), F.col("tool_name"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("role"), F.lit("]")))
    line = F.concat(label, F.lit("\n"), F.col("text"), F.lit("\n\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "sub_index", line.alias("line")))), lambda x: x["line"])
    return chunks.groupBy("session_id").agg(F.concat(F.lit("Transcript:\n\n"), F.array_join(parts, "")).alias("prompt"))


def input_hashes(chunks: DataFrame, model: str) -> DataFrame:
    """By session, the hash that tells whether a cached summary still holds."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "sub_index", "chunk_id", "text"))), lambda x: F.struct(x["chunk_id"].alias("id"), x["text"].alias("text")))
    return chunks.groupBy("session_id").agg(ids.summary_hash(model, rows).alias("input_hash"))


def doctor(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Totals by project and over all (project_id null)."""
    by = records.groupBy("project_id", "session_id").agg(F.count("*").alias("n"), F.count_if(F.col("ty") == "user").alias("u"))
    return by.rollup("project_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("records"), F.sum("u").alias("user_records"))
