"""Transcripts: line-delimited JSON files, read without failing on any line.

A project is a folder under the root; a session is a `.jsonl` file in it, or, for side sessions, one in a folder named
`subagents` at any depth below, with `<stem>.meta.json` beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.functions import text as tx
from palimpsest.sources import lines as ln

PREVIEW_CHARS = 300
FILES = "path string, modified timestamp, length long, sha string, project_id string, session_id string, is_sidechain boolean, parent_session string, agent_type string, description string"


def listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below root, with path, modificationTime, length and content, which is read only where it is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def discover(spark: SparkSession, root: str, sha: bool = True) -> DataFrame:
    """The session files under root with their identity, project, and sidecars; without sha, only the sidecars are read, and it is
    null. A root that isn't there: none. A sidecar that isn't UTF-8 or JSON counts as none."""
    from palimpsest.plans.materialize import exists

    if not exists(spark, root):
        return spark.createDataFrame([], FILES)
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rows = listed(spark, root, "*.jsonl").withColumn("rel", F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), len(prefix) + 1, 4096))
    parts = F.split("rel", "/")
    side = (F.size(parts) > 2) & (F.element_at(parts, -2) == "subagents")
    rows = rows.where(~F.col("rel").rlike(r"^\.") & ((F.size(parts) == 2) | side))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")
    rows = rows.select(
        "path", F.col("modificationTime").alias("modified"), "length", F.lit(None).cast("string").alias("sha"), parts[0].alias("project_id"), side.alias("side"), F.regexp_replace("path", r"\.jsonl$", "").alias("key"),
        F.when(side, F.regexp_replace(stem, "^agent-", "")).otherwise(stem).alias("session_id"), F.when(side, F.element_at(parts, -3)).alias("above"),
    )
    meta = listed(spark, root, "*.meta.json").select(F.regexp_replace("path", r"\.meta\.json$", "").alias("key"), F.try_parse_json(ln.valid("content")).alias("v")).where("v is not null")
    meta = meta.select("key", F.try_variant_get("v", "$.agentType", "string").alias("agent_type"), F.try_variant_get("v", "$.description", "string").alias("description"), F.lit(True).alias("has_meta"))
    out = rows.join(meta, "key", "left").withColumn("is_sidechain", F.col("side") & F.coalesce("has_meta", F.lit(False)))
    out = out.select("path", "modified", "length", "sha", "project_id", "session_id", "is_sidechain", F.when(F.col("is_sidechain"), F.col("above")).alias("parent_session"), "agent_type", "description")
    return with_sha(spark, out) if sha else out


def with_sha(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files with the SHA-256 of their content; null where it can't be read."""
    return files.drop("sha").join(ln.hashes(files), "path", "left").select(*files.columns)


def scan(files: DataFrame, size: int = ln.RANGE) -> DataFrame:
    """lines.read() of files (path, length and, if only what follows is to be read, start)."""
    files = files if "start" in files.columns else files.withColumn("start", F.lit(0))
    return ln.read(ln.ranges(files, size).unionByName(ln.by_spark(files)))


def parse(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, session_id, project_id, line_no, v, first, at, size, ended): each line that isn't empty of rows, which are a written table of scan(), and its
    value, null where it isn't UTF-8 or can't be parsed. Of keys that a line repeats, the last counts. files: session_id and project_id,
    and line0 where lines have been read before."""
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    line0 = F.coalesce("line0", F.lit(0)) if "line0" in files.columns else F.lit(0)
    own = ln.numbered(rows).join(files.select("path", "session_id", "project_id", line0.alias("_line0")), "path")
    return own.select("path", "session_id", "project_id", (F.col("line_no") + F.col("_line0")).alias("line_no"), F.try_parse_json(ln.valid()).alias("v"), "first", "at", F.octet_length("line").cast("long").alias("size"), "ended")


def lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """parse() of whole files."""
    from palimpsest.plans.materialize import stash

    return parse(stash(scan(files), "scanned"), files)


def _get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _string(path: str) -> Column:
    """A value that is a string, else null."""
    return F.when(F.schema_of_variant(_get(path, "variant")) == "STRING", _get(path))


def _item(x: Column, name: str) -> Column:
    value = F.try_variant_get(x, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))


def records(parsed: DataFrame) -> DataFrame:
    """Parsed lines as records, in the order of their files: what chunking and roll-ups take. Lines of ranges (first) are numbered by sums over
    the ranges of their file; turn_index stays where it is known."""
    content = _get("message.content", "variant")
    kind = F.schema_of_variant(content)
    said = _string("message.content")
    empty = F.lit(None).cast("string")

    def block(x):
        ty = F.coalesce(_item(x, "type"), F.lit(""))
        shown = F.coalesce(tx.truncate(F.to_json(F.try_variant_get(x, "$.input", "variant")), PREVIEW_CHARS), F.lit(""))
        call = ty == "tool_use"
        return F.struct(ty.alias("kind"), F.when(ty == "text", _item(x, "text")).alias("text"), F.when(call, F.coalesce(_item(x, "id"), F.lit(""))).alias("id"), F.when(call, F.coalesce(_item(x, "name"), F.lit(""))).alias("name"), F.when(call, shown).alias("input_preview"))

    one = F.struct(F.lit("text").alias("kind"), said.alias("text"), empty.alias("id"), empty.alias("name"), empty.alias("input_preview"))
    items = F.when(kind.startswith("ARRAY"), _get("message.content", "array<variant>"))
    good = F.filter(F.transform(items, block), lambda b: b["kind"].isin("tool_use", "thinking") | ((b["kind"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")))
    none = F.array().cast("array<struct<kind:string,text:string,id:string,name:string,input_preview:string>>")
    blocks = F.when(F.coalesce(said, F.lit("")) != "", F.array(one)).when(items.isNotNull(), good).otherwise(none)
    listed = F.array_join(F.filter(F.transform(items, lambda x: _item(x, "text")), lambda s: s.isNotNull()), "\n")
    stamp = F.when(_string("timestamp").rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(_string("timestamp")))
    tokens = {n: F.coalesce(_get(f"message.usage.{k}", "long"), F.lit(0)).alias(n) for n, k in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cache_read_input_tokens"), ("cache_creation_tokens", "cache_creation_input_tokens"))}
    rows = parsed.where("v is not null")
    if "first" in parsed.columns and "turn_index" not in parsed.columns:
        counts = rows.groupBy("path", "first").agg(F.count("*").alias("_n"))
        before = counts.select("path", "first", (F.sum("_n").over(Window.partitionBy("path").orderBy("first")) - F.col("_n")).alias("_before"))
        place = F.row_number().over(Window.partitionBy("path", "first").orderBy("line_no")) - 1
        rows = rows.withColumn("_place", place).join(before, ["path", "first"]).withColumn("turn_index", (F.col("_before") + F.col("_place")).cast("int"))
    elif "turn_index" not in parsed.columns:
        rows = rows.withColumn("turn_index", F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1)
    return rows.select(
        "path", "session_id", "project_id", "line_no", "turn_index", F.coalesce(_string("type"), F.lit("")).alias("ty"), F.coalesce(_string("uuid"), F.lit("")).alias("uuid"), _string("parentUuid").alias("parent_uuid"), stamp.alias("timestamp"),
        _string("message.role").alias("role"), _string("message.model").alias("model"), blocks.alias("blocks"), _string("attachment.type").alias("attachment_kind"), _string("attachment.result").alias("attachment_text"),
        _string("cwd").alias("cwd"), _string("gitBranch").alias("git_branch"), F.when(_string("type") == "ai-title", _string("aiTitle")).alias("ai_title"),
        F.when(kind == "STRING", said).when(items.isNotNull() & (listed != ""), listed).alias("prompt_text"), *tokens.values(),
    )


def parse_stats(parsed: DataFrame) -> DataFrame:
    """Lines and bad lines by file."""
    return parsed.groupBy("path").agg(F.count("*").alias("total_lines"), F.count_if(F.col("v").isNull()).alias("bad_lines"))
