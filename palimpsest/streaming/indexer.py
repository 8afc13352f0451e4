"""Incremental indexing: new files are indexed whole, grown ones from where they ended, file by file in effect.

Spark's file source takes a path once, and transcripts grow in place; so a run compares a listing with the manifest
of what was indexed: by time and length first. A longer file whose bytes before the old end are the same is read from there on, with the
numbers of lines and records carried in the manifest; others are compared by content, and indexed whole where it differs. Files that are
gone stay indexed unless they are collected. follow() does so whenever a stream of file events tells of one; for folders of files that never change once written, watch() does
it from a stream's micro-batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.functions.tokens import Bpe
from palimpsest.operators import cache, chunking
from palimpsest.operators import sessions as se
from palimpsest.plans.materialize import Stash, shared_path, stash
from palimpsest.sources import lines as ln
from palimpsest.sources import transcripts
from palimpsest.sources.store import Store
from palimpsest.streaming.files import file_events

#: Texts to vectors: a column of strings to a column of arrays of doubles.
Embed = Callable[[DataFrame], DataFrame]


def hashed_bag(rows: DataFrame, dims: int = 64) -> DataFrame:
    """(hash, text) to (hash, embedding): words counted in hashed buckets, normalised. Stands in for a model."""
    bins = rows.select("hash", F.explode(tx.words(F.lower("text"))).alias("w")).groupBy("hash", F.pmod(F.xxhash64("w"), F.lit(dims)).cast("int").alias("b")).agg(F.count("*").cast("double").alias("x"))
    filled = bins.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return rows.select("hash").join(filled, "hash", "left").select("hash", vx.normalise(F.coalesce(vector, F.array_repeat(F.lit(0.0), dims))).alias("embedding"))


def changed(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path and content aren't in the manifest together."""
    return listing.join(manifest.select("path", "sha"), ["path", "sha"], "left_anti")


def touched(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that aren't in the manifest with their time and length: those whose content has to be looked at."""
    same = (listing["path"] == manifest["path"]) & (listing["modified"] == manifest["modified"]) & (listing["length"] == manifest["length"])
    return listing.join(manifest, same, "left_anti")


def gone(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(listing.select("path"), "path", "left_anti")


def check_dimension(vectors: DataFrame, known: int | None) -> None:
    """ValueError unless all vectors have the same number of components, and that of the known ones."""
    sizes = sorted(r["n"] for r in vectors.select(F.size("embedding").alias("n")).distinct().limit(2).collect())
    if len(sizes) > 1 or known and sizes and sizes[0] != known:
        raise ValueError(f"vectors of {sizes} components, but {known or 'one number'} expected")


NOTHING = {"files": 0, "chunks": 0, "hits": 0, "misses": 0, "bytes": 0}
_STATE = ("offset", "lines", "records", "open_bad", "tail")


def grown(listing: DataFrame, known: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files of a listing that have only grown since the manifest: longer, the bytes before the old end the same, the line there whole, and the
    session's rows those of that end. With start, line0, turn0 and was_bad, which index() goes on from, and the old sha."""
    old = known.select("path", F.col("sha").alias("_sha"), F.col("offset").alias("start"), F.col("lines").alias("line0"), F.col("records").alias("turn0"), F.col("open_bad").alias("was_bad"), "tail")
    rows = listing.join(old, "path").where("start > 0 and length > start").join(sessions.select("session_id", F.col("indexed").alias("start")), ["session_id", "start"], "left_semi")
    rows = stash(rows, "longer")
    found = ln.tails(rows, "start").withColumnRenamed("tail", "now")
    rows = rows.join(found, "path").where((F.col("tail") == F.col("now")) & (F.col("ended") | F.coalesce(F.col("next") == F.lit(b"\n"), F.lit(False))))
    return rows.withColumn("sha", F.col("_sha")).select(*listing.columns, "start", "line0", "turn0", "was_bad")


def state(files: DataFrame, scanned: DataFrame, parsed: DataFrame) -> DataFrame:
    """files with what a later run goes on from: the offset up to which lines count, newlines and records before it, and whether a line that nothing
    ended was bad, which then is read again. sha of a grown file: of the old one and of what was appended."""
    read = scanned.where("lines is not null").groupBy("path").agg(F.sum("lines").alias("_lines"), F.sum("bytes").alias("_bytes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "sha"))), lambda x: x["sha"]), ",").alias("_shas"))
    rest = parsed.where("not ended and v is null").select("path", "size")
    good = parsed.groupBy("path").agg(F.count_if(F.col("v").isNotNull()).alias("_records"))
    out = files.join(read, "path", "left").join(rest, "path", "left").join(good, "path", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    out = out.select(
        *[c for c in files.columns if c not in ("sha", *_STATE)], F.when(F.col("start") > 0, F.sha2(F.concat_ws(",", "sha", "_shas"), 256)).otherwise(F.col("sha")).alias("sha"),
        (n("start") + n("_bytes") - n("size")).alias("offset"), (n("line0") + n("_lines")).alias("lines"), (n("turn0") + n("_records")).cast("long").alias("records"), F.col("size").isNotNull().alias("open_bad"),
    )
    out = stash(out, "read")
    return out.join(ln.tails(out, "offset").select("path", "tail"), "path", "left")


def tool_lines(records: DataFrame, parsed: DataFrame) -> DataFrame:
    """Where the lines of tool calls and of their results are, by the call's message."""
    call = (F.col("ty") == "assistant") & F.exists("blocks", lambda b: b["kind"] == "tool_use")
    result = (F.col("ty") == "attachment") & (F.col("attachment_kind") == "tool-result")
    rows = records.where(call | result).select("session_id", F.when(call, F.col("uuid")).otherwise(F.col("parent_uuid")).alias("uuid"), "path", "turn_index", "line_no")
    return rows.join(parsed.select("path", "line_no", "at", "size"), ["path", "line_no"])


def with_late_results(store: Store, files: DataFrame, new: DataFrame, lines: DataFrame) -> DataFrame:
    """Records to chunk: the new ones, and those of earlier calls of which a result has come now, with their results, read again."""
    tools = lines.join(files.where("start > 0").select("session_id"), "session_id", "left_semi")
    again = store.read("tool_lines").join(tools.select("session_id", "uuid").distinct(), ["session_id", "uuid"], "left_semi")
    again = stash(again.join(files.select("path", "project_id"), "path"), "read-again")
    if again.isEmpty():
        return new
    parts = again.select("path", F.col("at").alias("start"), F.col("at").alias("first"), (F.col("at") + 1).alias("last"), (F.col("at") + F.col("size")).alias("length"), F.lit(None).cast("binary").alias("content"))
    found = ln.read(parts).where("line is not null").select("path", "at", F.try_parse_json(ln.valid()).alias("v"))
    old = again.select("path", "session_id", "project_id", "line_no", "turn_index", "at").join(found, ["path", "at"])
    return new.unionByName(transcripts.records(old).select(*new.columns))


def index(store: Store, files: DataFrame, embed: Embed = hashed_bag, tokens: Bpe | None = None) -> dict[str, int]:
    """Parse, roll up, chunk, embed what the cache lacks, and put the sessions' rows in the place of their old ones; a saved summary
    stays. Of files with a start (as grown() gives them) only what follows is read, and its rows are added to their sessions'. Counts of files,
    chunks made, cache hits and misses, bytes of lines read, and files that can't be read (failed), which wait for the next run. Running it again on
    the same files changes nothing. The manifest is written last, so that files of a run that was cut short are indexed again, and whole."""
    spark = store.spark
    for name, kind in (("start", "long"), ("line0", "long"), ("turn0", "long"), ("was_bad", "boolean")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    files = stash(files, "files")
    if files.isEmpty():
        return dict(NOTHING)
    scanned = Stash(transcripts.scan(files), "scanned")
    bad = stash(scanned.df.where("error is not null").select("path").distinct(), "unreadable")
    failed = bad.count()
    if failed:
        files = stash(files.join(bad, "path", "left_anti"), "files")
    n = files.count()
    if not n:
        return NOTHING | {"failed": failed}
    parsed = Stash(transcripts.parse(scanned.df, files).withColumn("j", F.to_json("v")).drop("v"), "lines")
    lines = parsed.df.withColumn("v", F.try_parse_json("j"))
    now = stash(state(files, scanned.df, lines), "files-now")
    records = transcripts.records(lines).join(files.select("path", "turn0"), "path").withColumn("turn_index", (F.col("turn_index") + F.coalesce("turn0", F.lit(0))).cast("int")).drop("turn0")
    records = Stash(records, "records").df
    tools = stash(tool_lines(records, lines), "tool-lines")
    own, more = files.select("session_id").distinct(), files.where("start > 0").select("session_id")
    grew = not more.isEmpty()
    base = {name: store.version(name) for name in ("sessions", "usage", "chunks", "vectors", "tool_lines", "stats")} if grew else {}
    old = lambda name: store.read(name).join(more, "session_id", "left_semi")
    rolled = se.rollup(records)
    side = now.select("session_id", "project_id", "sha", "is_sidechain", "parent_session", F.col("offset").alias("indexed"))
    side = side.join(store.read("sessions").select("session_id", "summary"), "session_id", "left")
    if grew:
        rolled = se.merge_rollups(old("sessions"), rolled)
    sessions = side.drop("project_id").join(rolled, "session_id").withColumn("content_hash", ids.session_hash(F.col("sha"), F.col("message_count")))
    chunks = Stash(chunking.chunk(with_late_results(store, files, records, tools) if grew else records, tokens), "chunks").df
    looked = Stash(cache.cached(chunks, store.read("embedding_cache")), "looked-up").df
    fresh = stash(embed(cache.misses(looked)), "embedded")
    check_dimension(fresh, store.dimension())
    counts = looked.agg(F.count("*").alias("n"), F.count_if("hit").alias("h")).first()
    vectors = looked.drop("embedding").join(store.read("embedding_cache").unionByName(fresh), "hash").select("chunk_id", "session_id", "project_id", "started_at", vx.normalise(F.col("embedding")).alias("embedding"))
    vectors = stash(vectors, "vectors")
    usage = se.usage(records)
    stats = transcripts.parse_stats(lines)
    if grew:
        usage = se.merge_usage(old("usage"), usage)
        # a line that nothing ended and was bad has been read again
        again = files.where("was_bad").select("path", F.lit(-1).cast("long").alias("total_lines"), F.lit(-1).cast("long").alias("bad_lines"))
        before = store.read("stats").join(files.where("start > 0").select("path"), "path", "left_semi")
        stats = stats.unionByName(again).unionByName(before.select(*stats.columns)).groupBy("path").agg(F.sum("total_lines").alias("total_lines"), F.sum("bad_lines").alias("bad_lines"))
        chunks = cache.merge(old("chunks"), chunks, ["chunk_id"])
        vectors = cache.merge(old("vectors"), vectors, ["chunk_id"])
        tools = cache.merge(old("tool_lines").select(*tools.columns), tools, ["session_id", "line_no"])
    if counts["n"] > counts["h"]:
        store.append("embedding_cache", fresh)
    # the rows of these sessions go as a whole, and stale chunks with them; sessions come first, as they say up to where rows are
    put = lambda name, rows, own=own: store.replace(name, stash(rows, f"{name}-now"), own, base.get(name))
    put("sessions", sessions)
    with ThreadPoolExecutor(5) as pool:  # Spark runs them side by side
        for done in [pool.submit(put, *x) for x in (("usage", usage), ("chunks", chunks), ("vectors", vectors), ("tool_lines", tools), ("stats", stats, None))]:
            done.result()
    store.replace("files", now)
    read = scanned.df.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    parsed.drop()
    scanned.drop()
    return {"files": n, "chunks": counts["n"], "hits": counts["h"], "misses": counts["n"] - counts["h"], "bytes": read} | ({"failed": failed} if failed else {})


def refresh(store: Store, root: str, embed: Embed = hashed_bag, collect_gone: bool = False, progress: Callable[[int, int], None] | None = None, step: int = 25, settle: float = 0.0, tokens: Bpe | None = None) -> dict[str, int]:
    """One pass over a folder: index what changed since the last. Only files of another time or length than the manifest's are read, grown ones from where
    they ended. Files that can't be read are counted as failed and tried again next time; the others go on. progress: called with the files
    done and their number after about every `step` of them; without it all go in one run. settle: files changed in the last so many seconds wait."""
    listing = transcripts.discover(store.spark, root, sha=False)
    if settle:
        listing = listing.where(F.col("modified") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(settle))))
    listing = stash(listing, "listing")
    known = store.read("files")
    new = stash(touched(listing, known), "touched")
    longer = stash(grown(new, known, store.read("sessions")), "grown")
    looked = stash(transcripts.with_sha(store.spark, new.join(longer.select("path"), "path", "left_anti")), "looked-at")
    read = looked.where("sha is not null")
    todo = stash(changed(read, known).unionByName(longer, allowMissingColumns=True), "changed")
    total, out = todo.count(), dict(NOTHING)
    parts = -(-total // step) if progress else 1
    deal = F.pmod(F.xxhash64("path"), F.lit(max(parts, 1)))
    done = 0
    for k in range(parts):
        got = index(store, todo.where(deal == k) if progress else todo, embed, tokens)
        for name, n in got.items():
            out[name] = out.get(name, 0) + n
        done += got["files"] + got.get("failed", 0)
        if progress and (got["files"] or k == parts - 1):
            progress(done, total)
    # others are as they were, at another time
    moved = read.join(todo.select("path"), "path", "left_anti")
    if not moved.isEmpty():
        moved = moved.drop("modified").join(known.select("path", *_STATE), "path", "left").join(read.select("path", "modified"), "path")
        store.replace("files", stash(moved, "moved"))
    if failed := looked.where("sha is null").count():
        out["failed"] = out.get("failed", 0) + failed
    if collect_gone:
        lost = stash(gone(listing, store.read("files")).select("path", "session_id"), "gone")
        for name in ("sessions", "usage", "chunks", "vectors", "tool_lines", "files", "stats"):
            store.remove(name, lost)
    return out


def watch(store: Store, root: str, checkpoint: str, embed: Embed = hashed_bag, trigger: dict | None = None):
    """A streaming query that indexes files as they appear under root; for files that don't grow afterwards."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = store.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root).select("path")

    def batch(rows: DataFrame, _: int) -> None:
        paths = stash(rows.select("path").distinct(), "arrived")
        index(store, transcripts.discover(store.spark, root).join(paths, "path", "left_semi"), embed)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow(store: Store, root: str, embed: Embed = hashed_bag, every: str = "1 second", settle: float = 0.25, collect_gone: bool = False, events: Events | None = None, tokens: Bpe | None = None, checkpoint: str | None = None):
    """A streaming query that indexes files as they are made, grow or go (files.file_events): a file once it has been quiet for `settle` seconds, and
    nothing runs on Spark while nothing happens. Files that are gone stay indexed unless collect_gone. events: told what each round did, if
    anything. checkpoint: a folder from which a later query goes on; without one, a query starts with all files that are there, of which those that are
    indexed cost a look at the manifest."""
    home = checkpoint.rstrip("/") if checkpoint else shared_path(store.spark, "follow")
    happened = file_events(store.spark, root, f"{home}/journal", settle=settle)

    def batch(rows: DataFrame, _: int) -> None:
        if rows.isEmpty():
            return
        done = refresh(store, root, embed, collect_gone, tokens=tokens)
        if events and any(done.values()):
            events.publish(done)

    return happened.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/checkpoint").trigger(processingTime=every).start()


class Events:
    """What happened, for any number of subscribers. Each holds the last `most` events that it hasn't taken; one that falls
    behind is closed, so that it can tell and start anew."""

    def __init__(self, most: int = 1024):
        self.most, self.subscribers = most, []

    def subscribe(self) -> Subscriber:
        self.subscribers.append(Subscriber(self.most))
        return self.subscribers[-1]

    def publish(self, event) -> None:
        for s in self.subscribers:
            s.put(event)
        self.subscribers = [s for s in self.subscribers if not s.closed]


class Subscriber:
    def __init__(self, most: int):
        self.held, self.most, self.closed = deque(), most, False

    def put(self, event) -> None:
        if len(self.held) == self.most:
            self.closed = True
        else:
            self.held.append(event)

    def take(self) -> list:
        """Events since the last call."""
        out = []
        while self.held:
            out.append(self.held.popleft())
        return out


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream or table of events by type and window of event time."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
