"""The engine as one object over a store: what its routes, tools and commands do, as methods that return DataFrames."""

from __future__ import annotations

import hashlib
import logging
import os
import time
from collections.abc import Callable
from dataclasses import asdict, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import Config, save, validate
from palimpsest.functions import text as tx
from palimpsest.functions.tokens import Bpe
from palimpsest.operators import cluster, graph, memory, recall
from palimpsest.operators import sessions as se
from palimpsest.plans.materialize import stash
from palimpsest.sources.store import Store
from palimpsest.streaming import indexer

MARKS = ("<!-- palimpsest:start -->", "<!-- palimpsest:end -->")
SUMMARY_PROMPT = 'Summarize the session. Answer with JSON: {"text": two to four sentences, "bullets": [], "decisions": [], "artifacts": []}.'
NAMING_PROMPT = "Name the topic of these excerpts in three to six words. Answer with the name alone, specific, without quotes or a full stop."
log = logging.getLogger(__name__)


def safe_id(x: str) -> str:
    """x, or ValueError where it can't be an id."""
    if not x or len(x.encode()) > 256 or any(c in x for c in "/\\\0") or x in (".", ".."):
        raise ValueError("not an id")
    return x


class Engine:
    """embed: (hash, text) rows to (hash, embedding). complete: (system, user) prompts to a reply; None without a model. model: its
    name, which summaries are cached by. tokens: the vocabulary that chunks are cut and counted by; words without one."""

    def __init__(self, spark: SparkSession, root: str, embed=indexer.hashed_bag, complete: Callable[[str, str], str] | None = None, config: Config | None = None, model: str = "model", tokens: Bpe | None = None):
        self.spark, self.store, self.embed, self.complete, self.config, self.model = spark, Store(spark, root), embed, complete, config or Config(), model
        self.tokens = tokens
        self.indexing, self.events = False, indexer.Events()

    def vector(self, text: str) -> list[float]:
        return self.vectors([text])[0]

    def vectors(self, texts: list[str]) -> list[list[float]]:
        """Of a few texts, embedded together."""
        rows = self.embed(self.spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "hash string, text string")).collect()
        found = {r["hash"]: list(r["embedding"]) for r in rows}
        return [found[str(k)] for k in range(len(texts))]

    def _value(self, c):
        """What an expression over literals gives."""
        return self.spark.range(1).select(c.alias("x")).first()["x"]

    # indexing

    def refresh(self, folder: str, progress: Callable[[int, int], None] | None = None, collect_gone: bool = False) -> dict[str, int]:
        """Index what is new or changed; progress as in indexer.refresh. Subscribers of events are told."""
        self.indexing = True
        try:
            done = indexer.refresh(self.store, folder, self.embed, collect_gone, progress, tokens=self.tokens)
        finally:
            self.indexing = False
        if any(done.values()):
            self.events.publish(done)
        return done

    def follow(self, folder: str, **how):
        """A streaming query that keeps the index up with a folder."""
        return indexer.follow(self.store, folder, self.embed, events=self.events, tokens=self.tokens, **how)

    # recall

    def recall(self, query: str, project: str | None = None, session: str | None = None, limit: int = 10, budget: int = 4000, min_score: float = 0.0, paths: list[str] = (), source: str = "api") -> dict[str, DataFrame | list]:
        """items: chunks; memories: those that apply to the project; stats; truncated: whether limit or budget left any out. Hits are
        recorded, and hot chunks promoted where the settings say so; a promotion that fails costs no recall."""
        if len(query.encode()) > 8192:
            raise ValueError("a query has at most 8192 bytes")
        chunks, vectors = self.store.read("chunks"), self.store.read("vectors")
        words = recall.query_keywords(chunks, query)
        v = self.vector(" ".join(words) or query)
        known = self.store.dimension()
        if known and len(v) != known:
            raise ValueError(f"the query's vector has {len(v)} components, the stored ones {known}")
        sessions = self.store.read("sessions").select("session_id", F.coalesce("ai_title", "first_prompt").alias("title"))
        items = stash(recall.recall(chunks, vectors, sessions, query, v, limit, budget, project, min_score), "recalled")
        used, truncated = items.agg(F.coalesce(F.sum("token_count"), F.lit(0)), F.coalesce(F.bool_or("truncated"), F.lit(False))).first()
        now = datetime.now(UTC)
        hits = items.select("chunk_id", F.lit(session).cast("string").alias("session_id"), "project_id", F.lit(source).alias("source"), F.lit(now).alias("hit_at"))
        self.store.append("hits", hits)
        self.store.append("metrics", self.spark.createDataFrame([(now, query, items.count(), used)], "at timestamp, query string, items int, tokens long"))
        found = memory.candidates(self.store.read("memories"), project, query, v, paths, self.config.hook.max_always_injected)
        memories = memory.admit([r.asDict() for r in found.collect()], budget, used, max(min_score, recall.FLOOR), self.config.hook.max_always_injected)
        if self.config.auto_promote and source != "hook" and project:
            try:
                self.promote_file(project)
            except Exception:  # whatever the model or the project's folder does
                log.warning("promotion of %s failed", project, exc_info=True)
        return {"items": items, "memories": memories, "stats": recall.stats(chunks, used, project), "truncated": truncated}

    def hook(self, prompt: str, project: str | None = None, session: str = "", cwd: str | None = None) -> str:
        """What a prompt hook adds: a line of counts, recalled chunks of other sessions and memories that apply, as text; nothing for
        short prompts or where nothing is found. Without a project it is the one of cwd, which also is a path for globs."""
        h = self.config.hook
        if len(prompt.split()) < h.min_words:
            return ""
        project = project or (cwd.replace("/", "-") if cwd else None)
        cut = prompt.encode()[:2000].decode(errors="ignore")
        found = self.recall(cut, project if h.scope == "project" else None, session, h.limit, h.token_budget, h.score_threshold, [cwd] if cwd else (), "hook")
        rows = found["items"].where(F.col("session_id") != session).orderBy("rank").collect()
        if not rows and not found["memories"]:
            return ""
        stats = found["stats"].first()
        head = f"{len(rows)} chunks, {sum(r['token_count'] for r in rows)} tokens of {stats['total_tokens']} in {stats['chunk_count']} indexed chunks."
        parts = [f"### {r['title'] or r['session_id']} ({r['why']})\n{r['text']}" for r in rows]
        notes = [f"- {m['content']} ({m['why']})" for m in found["memories"]]
        return "\n\n".join([head, *parts, *(["### Memories\n" + "\n".join(notes)] if notes else [])]) + "\n"

    def search(self, query: str, limit: int = 10, project: str | None = None) -> DataFrame:
        near = recall.search(self.store.read("vectors"), self.vector(query), limit, project).select("chunk_id", "score")
        rows = self.store.read("chunks").join(F.broadcast(near), "chunk_id").join(self.store.read("sessions").select("session_id", F.coalesce("ai_title", "first_prompt", "session_id").alias("title")), "session_id", "left")
        return rows.select("chunk_id", "score", "title", tx.clip(tx.one_line("text", " ⏎ "), 220).alias("snippet")).orderBy(F.desc("score"), "chunk_id")

    def metrics(self) -> DataFrame:
        return self.store.read("metrics").orderBy(F.desc("at")).limit(50)

    # listings

    def list_projects(self) -> DataFrame:
        return se.project_summary(self.store.read("sessions")).orderBy("project_id")

    def recent_project(self) -> str | None:
        """The project of the latest session."""
        row = se.recent_project(self.store.read("sessions")).first()
        return row["project_id"] if row else None

    def list_sessions(self, project: str | None = None, limit: int = 50) -> DataFrame:
        return se.recent(self.store.read("sessions"), project, limit)

    def list_unsummarized_sessions(self, project: str | None = None, limit: int = 20) -> DataFrame:
        return se.unsummarized(self.store.read("sessions"), project, limit)

    def get_session_transcript(self, session: str, most_bytes: int | None = None) -> str | None:
        row = se.transcript(self.store.read("chunks").where(F.col("session_id") == safe_id(session)), most_bytes).first()
        return row["transcript"] if row else None

    def get_session(self, session: str) -> dict | None:
        row = self.store.read("sessions").where(F.col("session_id") == safe_id(session)).first()
        return row.asDict() if row else None

    def get_chunk(self, chunk: str) -> dict | None:
        row = self.store.read("chunks").where(F.col("chunk_id") == safe_id(chunk)).first()
        return row.asDict() if row else None

    def health(self) -> dict[str, int | bool]:
        return {n: self.store.read(n).count() for n in ("sessions", "chunks", "topics", "memories")} | {"indexing": self.indexing}

    # settings

    def get_settings(self) -> dict:
        return asdict(self.config)

    def put_settings(self, path: str | None = None, **changes) -> dict:
        """Change settings (those of the hook in a dictionary of that name), and save them at path; ValueError where they are out of bounds
        or unknown, with nothing changed."""
        hook = changes.pop("hook", {})
        try:
            new = replace(self.config, **changes, hook=replace(self.config.hook, **hook))
        except TypeError as e:
            raise ValueError(str(e)) from e
        self.config = validate(new)
        if path:
            save(new, path)
        return self.get_settings()

    # summaries and topics

    def save_session_summary(self, session: str, text: str, items: list[str] = ()) -> None:
        if not 1 <= len(text) <= 4000 or len(items) > 16 or any(len(i) > 500 for i in items):
            raise ValueError("a summary has 1 to 4000 characters, and up to 16 items of up to 500")
        body = "\n".join([text, *(f"- {i}" for i in items)])
        self.store.replace("sessions", self.store.read("sessions").where(F.col("session_id") == session).withColumn("summary", F.lit(body)))

    def summarize(self, project: str | None = None, limit: int = 20, force: bool = False, session: str | None = None) -> dict[str, int]:
        """Summaries by the model of sessions without one; with force, of the latest whether they have one or not. The reply to an unchanged
        session is taken from the cache. Counts of sessions summarized, of those from the cache, skipped (no chunks) and failed."""
        out = {"summarized": 0, "cached": 0, "skipped": 0, "failed": 0}
        if not self.complete:
            return out
        asked = self.list_sessions(project, limit) if force or session else self.list_unsummarized_sessions(project, limit)
        if session:
            asked = self.store.read("sessions").where(F.col("session_id") == session)
        asked = asked.select("session_id", "summary")
        chunks = self.store.read("chunks").join(F.broadcast(asked.select("session_id")), "session_id", "left_semi")
        hashes = se.input_hashes(chunks, self.model).join(se.render(chunks), "session_id")
        cached = self.store.read("summaries").select("input_hash", F.col("text").alias("cached"))
        for r in asked.join(hashes, "session_id", "left").join(cached, "input_hash", "left").orderBy("session_id").collect():  # at most `limit` sessions
            if r["prompt"] is None:
                out["skipped"] += 1
                continue
            reply = r["cached"]
            if reply is None:
                try:
                    reply = self.complete(SUMMARY_PROMPT, r["prompt"]).strip()
                except Exception:  # one session's failure leaves the others
                    log.warning("summary of %s failed", r["session_id"], exc_info=True)
                if not reply:
                    out["failed"] += 1
                    continue
                self.store.replace("summaries", self.spark.createDataFrame([(r["input_hash"], r["session_id"], self.model, reply)], "input_hash string, session_id string, model string, text string"))
            else:
                out["cached"] += 1
            said = self._value(tx.summary_reply(F.lit(reply)))
            items = [i[:500] for k in ("bullets", "decisions", "artifacts") for i in said[k] if i][:16]
            self.save_session_summary(r["session_id"], said["text"].strip()[:4000] or reply[:4000], items)
            out["summarized"] += 1
        return out

    def cluster(self) -> DataFrame:
        """Cluster anew, replace topics and edges, and report. Names given to topics outlive it while their members stay."""
        vectors, chunks = self.store.read("vectors"), self.store.read("chunks")
        found = stash(cluster.dbscan(vectors), "clusters")
        topics = cluster.topics(vectors, found, chunks)
        names = self.store.read("topic_names").select("topic_id", F.col("label").alias("_l"), F.col("description").alias("_d"))
        topics = stash(topics.join(names, "topic_id", "left").withColumns({"label": F.coalesce("_l", "label"), "description": F.coalesce("_d", "description")}).drop("_l", "_d"), "topics")
        members = topics.select("topic_id", F.explode("members").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
        paths = members.select("topic_id", F.explode(tx.path_references("text")).alias("path"))
        near = cluster.similarity_edges(topics).select("edge_id", F.lit("topic-similarity").alias("kind"), "a", "b", "weight")
        files = cluster.shared_file_edges(paths).select("edge_id", F.lit("shared-file").alias("kind"), "a", "b", "weight")
        self.store.write("topics", topics)
        self.store.write("edges", near.unionByName(files))
        return cluster.report(vectors, found)

    def list_topics(self) -> DataFrame:
        return self.store.read("topics").orderBy(F.desc("size"), "topic_id")

    def name_topic(self, topic: str, label: str, description: str = "") -> None:
        if not 3 <= len(label) <= 80 or len(description) > 300:
            raise ValueError("a label has 3 to 80 characters, a description up to 300")
        row = self.spark.createDataFrame([(topic, label, description)], "topic_id string, label string, description string")
        self.store.replace("topic_names", row)
        rows = self.store.read("topics").where(F.col("topic_id") == topic)
        self.store.replace("topics", rows.withColumns({"label": F.lit(label), "description": F.when(F.lit(description) != "", F.lit(description)).otherwise(F.col("description"))}))

    def name_topics(self) -> int:
        """Names by the model for topics that have none of their own yet; how many. A topic keeps its name while its members stay, and one
        whose name fails stays as it is."""
        if not self.complete:
            return 0
        new = stash(self.store.read("topics").join(self.store.read("topic_names").select("topic_id"), "topic_id", "left_anti"), "unnamed")
        prompts = cluster.naming_prompts(new, self.store.read("chunks")).orderBy("topic_id")
        named = []
        for r in prompts.toLocalIterator():
            try:
                label = self._value(tx.clean_name(F.lit(self.complete(NAMING_PROMPT, r["prompt"]))))
            except Exception:  # one topic's failure leaves the others
                log.warning("naming of %s failed", r["topic_id"], exc_info=True)
                continue
            if label:
                named.append((r["topic_id"], label[:80]))
        if named:
            rows = self.spark.createDataFrame(named, "topic_id string, new string")
            topics = stash(self.store.read("topics").join(F.broadcast(rows), "topic_id").withColumn("label", F.col("new")).drop("new"), "named")
            self.store.replace("topic_names", topics.select("topic_id", "label", "description"))
            self.store.replace("topics", topics)
        return len(named)

    def graph(self, with_sessions: bool = True, search: str | None = None, kinds: list[str] | None = None, projects: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        sessions, topics, edges = (self.store.read(n) for n in ("sessions", "topics", "edges"))
        nodes, links = graph.nodes(sessions, topics, with_sessions), graph.edges(sessions, topics, edges, with_sessions)
        nodes = nodes.withColumn("label", F.when(F.col("kind") == "topic", tx.clean_label("label", "topic")).otherwise(F.col("label")))
        shown = graph.visible(nodes, links, search, kinds, projects)
        ids = shown.select("id")
        return shown, links.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")

    # memories

    def remember(self, project: str, content: str, source: str | None = None, scope: str | None = None, globs: list[str] | None = None, pinned: bool = False, now: int | None = None) -> tuple[str, str]:
        """(id, what was done: added, superseded, updated or known)."""
        source, scope, globs = memory.validate(content, source, scope, globs)
        content = self._value(tx.redact(F.lit(content.strip()))["text"])
        rows, now, v = self.store.read("memories"), int(time.time()) if now is None else now, self.vector(content)
        own = hashlib.sha256(f"{project}\n{scope}\n{content}\n{now}".encode()).hexdigest()[:32]
        row = {"id": own, "project_id": project, "content": content, "source": source, "pinned": pinned, "scope": scope, "globs": globs, "created_at": now, "updated_at": now, "embedding": v}
        if self.config.memory_reconcile and self.complete:
            known = [r.asDict() for r in (memory.search(rows, project, v, 5) if scope == "auto" else memory.nearest(rows, project, scope, v)).drop("score").collect()]
            if known:
                listed = "\n".join(f"{n}. {k['content']}" for n, k in enumerate(known, 1))
                verdict, fact = memory.reconcile(self.complete("Answer ADD, UPDATE n or NOOP n.", f"New fact:\n{content}\n\nKnown facts:\n{listed}"), known)
                if verdict == "noop":
                    return fact["id"], "known"
                if verdict == "update":
                    self._put(fact | {"content": content, "embedding": v, "updated_at": now})
                    return fact["id"], "updated"
                if verdict == "add":
                    self._put(row)
                    return own, "added"
        new, superseded = memory.settle(rows, row, self.config.dedupe())
        self._put(new)
        return new["id"], "superseded" if superseded else "added"

    def _put(self, *rows: dict) -> None:
        known = self.store.read("memories")
        self.store.replace("memories", self.spark.createDataFrame([tuple(r[c] for c in known.columns) for r in rows], known.schema))

    def distil(self, project: str, items: list[str], now: int | None = None) -> int:
        """A batch of distilled facts as memories: each distinct one once, embedded together, each superseding what it is nearly equal
        to. How many were written."""
        facts = [self._value(tx.redact(F.lit(f))["text"]) for f in memory.facts_of(items)]
        if not facts:
            return 0
        now = int(time.time()) if now is None else now
        blank = {"project_id": project, "source": "distilled", "pinned": False, "scope": "auto", "globs": None, "created_at": now, "updated_at": now}
        rows = [blank | {"id": hashlib.sha256(f"{project}\nauto\n{f}\n{now}".encode()).hexdigest()[:32], "content": f, "embedding": v} for f, v in zip(facts, self.vectors(facts), strict=True)]
        # of each fact only the nearest known memory can matter
        near = [r.asDict() for row in rows for r in memory.nearest(self.store.read("memories"), project, "auto", row["embedding"]).drop("score").collect()]
        written = memory.distil(near, rows, self.config.dedupe())
        self._put(*written)
        return len(written)

    def update_memory(self, id_: str, content: str | None = None, pinned: bool | None = None, scope: str | None = None, globs: list[str] | None = None, now: int | None = None) -> bool:
        found = self.store.read("memories").where(F.col("id") == id_).first()
        if not found:
            return False
        row = found.asDict()
        if scope is not None or globs is not None:
            _, row["scope"], row["globs"] = memory.validate(None, None, scope or row["scope"], globs if globs is not None else row["globs"])
        if content is not None:
            memory.validate(content)
            row["content"] = self._value(tx.redact(F.lit(content.strip()))["text"])
            row["embedding"] = self.vector(row["content"])
        if pinned is not None:
            row["pinned"] = pinned
        self._put(row | {"updated_at": int(time.time()) if now is None else now})
        return True

    def forget(self, id_: str) -> bool:
        found = self.store.read("memories").where(F.col("id") == id_).select("id")
        if found.isEmpty():
            return False
        self.store.remove("memories", found)
        return True

    def get_memory(self, id_: str) -> dict | None:
        row = self.store.read("memories").where(F.col("id") == id_).drop("embedding").first()
        return row.asDict() if row else None

    def has_memory(self, project: str, content: str) -> bool:
        """Whether a project has a memory of exactly this content."""
        return not self.store.read("memories").where((F.col("project_id") == project) & (F.col("content") == content)).isEmpty()

    def count_memories(self, project: str) -> int:
        return self.store.read("memories").where(F.col("project_id") == project).count()

    def list_memories(self, project: str, scope: str | None = None, limit: int = 100) -> DataFrame:
        return memory.list_memories(self.store.read("memories"), project, scope, limit).drop("embedding")

    def search_memories(self, project: str, query: str, limit: int = 10) -> DataFrame:
        return memory.search(self.store.read("memories"), project, self.vector(query), limit).drop("embedding")

    # promotion

    def promote(self, project: str, existing: str, least: int = 3, days: int = 30, now: datetime | None = None) -> str | None:
        """existing with a block of facts distilled from hot chunks; None where nothing is hot, new or the model is missing."""
        since = (now or datetime.now(UTC)) - timedelta(days=days)
        hot = se.hot_chunks(self.store.read("hits"), self.store.read("chunks"), project, since, least)
        hot = hot.select("distinct_sessions", tx.truncate_bytes("text", 800).alias("text")).collect()
        if not hot or not self.complete:
            return None
        prompt = "\n\n".join(f"Excerpt {n} (in {r['distinct_sessions']} sessions):\n{r['text']}" for n, r in enumerate(hot, 1))
        reply = self.complete("List durable facts about the project as short bullets.", prompt)
        facts = self._value(tx.bullets(F.lit(reply)))
        digest = hashlib.sha256("\n".join(facts).encode()).hexdigest()
        done = self.store.read("promotions").where((F.col("project_id") == project) & (F.col("content_hash") == digest)).count()
        if not facts or done:
            return None
        self.distil(project, facts)
        row = self.spark.createDataFrame([(project, "block", digest, now or datetime.now(UTC))], "project_id string, target string, content_hash string, promoted_at timestamp")
        self.store.replace("promotions", row)
        return memory.splice(existing, "## Recalled facts\n\n" + "\n".join(facts), *MARKS)

    def promote_file(self, project: str, **how) -> str | None:
        """promote() into the notes file of the project's latest folder, written beside it and renamed; its path, or None where there is
        nothing to write or no such folder. The folder is one of the machine that the engine runs on."""
        row = se.project_cwd(self.store.read("sessions").where(F.col("project_id") == project)).first()
        if not row or not row["cwd"] or not os.path.isdir(row["cwd"]):
            return None
        path = os.path.join(row["cwd"], self.config.notes_file)
        existing = ""
        if os.path.exists(path):
            with open(path) as f:
                existing = f.read()
        text = self.promote(project, existing, **how)
        if text is None:
            return None
        with open(f"{path}.new", "w") as f:
            f.write(text)
        os.replace(f"{path}.new", path)
        return path
