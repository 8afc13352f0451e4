"""Scoped memories: listing, search, injection in tiers, and writes that supersede near-duplicates."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.operators import globs

GLOBAL = "__global__"
SCOPES, SOURCES = ("auto", "always", "glob", "manual"), ("agent", "user", "distilled")
SCHEMA = "id string, project_id string, content string, source string, pinned boolean, scope string, globs array<string>, created_at long, updated_at long, embedding array<double>"
MOST_GLOBS, MOST_GLOB_BYTES, MOST_CONTENT_BYTES, MOST_PATHS = 32, 256, 8192, 128
RECENCY = 0.03


def validate(content: str | None = None, source: str | None = None, scope: str | None = None, globs: list[str] | None = None) -> tuple[str, str, list[str] | None]:
    """(source, scope, globs) with defaults, or ValueError."""
    source, scope = source or "agent", scope or "auto"
    if source not in SOURCES:
        raise ValueError(f"source must be one of {'|'.join(SOURCES)}")
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {'|'.join(SCOPES)}")
    own = [g.strip() for g in globs or [] if g.strip()]
    if len(own) > MOST_GLOBS or any(len(g.encode()) > MOST_GLOB_BYTES for g in own):
        raise ValueError(f"at most {MOST_GLOBS} globs of {MOST_GLOB_BYTES} bytes")
    if any(tx.glob_regex(g) is None for g in own):
        raise ValueError("a glob is malformed")
    if scope == "glob" and not own:
        raise ValueError("scope glob needs globs")
    if content is not None and not (content.strip() and len(content.strip().encode()) <= MOST_CONTENT_BYTES):
        raise ValueError(f"content must have 1 to {MOST_CONTENT_BYTES} bytes")
    return source, scope, own if scope == "glob" else None


def list_memories(memories: DataFrame, project: str, scope: str | None = None, limit: int | None = 100) -> DataFrame:
    """Pinned ones first, then the latest; at most 500, or all where limit is None."""
    rows = memories.where(F.col("project_id") == project)
    if scope:
        rows = rows.where(F.coalesce("scope", F.lit("auto")) == scope)
    rows = rows.orderBy(F.desc("pinned"), F.desc("updated_at"), "id")
    return rows if limit is None else rows.limit(min(max(limit, 1), 500))


def with_global(memories: DataFrame, project: str, limit: int | None = 100) -> DataFrame:
    """A project's memories and the global ones, each id once; limit as in list_memories, for each of the two."""
    both = list_memories(memories, project, None, limit).unionByName(list_memories(memories, GLOBAL, None, limit))
    return both.dropDuplicates(["id"]).orderBy(F.desc("pinned"), F.desc("updated_at"), "id")


def search(memories: DataFrame, project: str, query, limit: int = 10) -> DataFrame:
    """Automatic memories by cosine, with a score."""
    rows = memories.where((F.col("project_id") == project) & (F.coalesce("scope", F.lit("auto")) == "auto") & F.col("embedding").isNotNull())
    return rows.withColumn("score", vx.cosine(F.col("embedding"), vx.literal(query))).orderBy(F.desc("score"), "id").limit(min(max(limit, 1), 100))


def nearest(memories: DataFrame, project: str, scope: str, query) -> DataFrame:
    """The most similar memory of a project and scope that isn't pinned, with a score."""
    rows = memories.where((F.col("project_id") == project) & (F.coalesce("scope", F.lit("auto")) == scope) & ~F.col("pinned") & F.col("embedding").isNotNull())
    return rows.withColumn("score", vx.cosine(F.col("embedding"), vx.literal(query))).orderBy(F.desc("score"), "id").limit(1)


def scopes(project: str | None) -> list[str]:
    return [] if not project else [project] if project == GLOBAL else [project, GLOBAL]


def by_paths(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id, glob): the memories of scope glob that paths of many requests (request_id, project_id, path) bring up, those of the request's
    project and global ones, each with the first of its own patterns that fits one of the request's paths. The second tier of candidates() for
    many requests at once, before its cut."""
    own = memories.where("scope = 'glob'").select("id", F.col("project_id").alias("_of"), F.posexplode("globs").alias("_k", "pattern"))
    fit = globs.matches(requests, own).join(own, "pattern")
    asked = requests.select("request_id", "project_id", "path").distinct().join(fit, "path").where((F.col("_of") == F.col("project_id")) | (F.col("_of") == GLOBAL))
    return asked.groupBy("request_id", "id").agg(F.min(F.struct("_k", "pattern"))["pattern"].alias("glob"))


def candidates(memories: DataFrame, project: str | None, query: str, query_vector, paths: list[str] = (), max_always: int = 3) -> DataFrame:
    """Memories of the three tiers in order: tier (int), place (int, within it), score and why. Bounded: a few for each scope."""
    own = scopes(project)
    rows = memories.where(F.col("project_id").isin(*own)) if own else memories.limit(0)
    rows = rows.withColumn("scope", F.coalesce("scope", F.lit("auto"))).withColumn("near", (F.col("project_id") != (own[0] if own else "")).cast("int"))
    listed = Window.partitionBy("project_id").orderBy(F.desc("pinned"), F.desc("updated_at"), "id")
    pin = F.when(F.col("pinned"), " · pinned").otherwise("")
    always = rows.where("scope = 'always'").withColumn("n", F.row_number().over(listed)).where(F.col("n") <= max_always).select("*", F.lit(1).alias("tier"), F.lit(1.0).alias("score"), F.lit(1.0).alias("rank_by"), F.concat(F.lit("standing rule (always)"), pin).alias("why"))
    looked = [p for p in paths if p and len(p.encode()) <= MOST_GLOB_BYTES][:MOST_PATHS]
    tokens = memories.sparkSession.range(1).select(tx.path_tokens(F.lit(query)).alias("p")).first()["p"]
    looked = list(dict.fromkeys([*looked, *tokens]))
    glob = rows.where("scope = 'glob'").withColumn("n", F.row_number().over(listed)).where(F.col("n") <= 50)
    if looked:
        patterns = {g for r in glob.select(F.explode("globs").alias("g")).distinct().collect() for g in [r["g"]]}
        good = [p for p in patterns if (rx := tx.glob_regex(p)) and any(re.search(_python(rx), x) or re.search(_python(rx), x.rsplit("/", 1)[-1]) for x in looked)]
        fits = F.array(*map(F.lit, good)).cast("array<string>")
        glob = glob.where(F.arrays_overlap("globs", fits))
    else:
        glob, fits = glob.limit(0), F.array().cast("array<string>")
    first = F.get(F.array_intersect("globs", fits), F.lit(0))  # of a memory's own patterns, in their order
    glob = glob.select("*", F.lit(2).alias("tier"), F.lit(0.9).alias("score"), F.lit(0.9).alias("rank_by"), F.format_string('matches glob "%s"', first).alias("why"))
    auto = rows.where("scope = 'auto' and embedding is not null").withColumn("score", vx.cosine(F.col("embedding"), vx.literal(query_vector)))
    auto = auto.withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "id"))).where("n <= 5")
    span = Window.partitionBy(F.lit(1))  # ten rows at most
    lo, hi = F.min("updated_at").over(span), F.max("updated_at").over(span)
    bonus = F.when(hi > lo, RECENCY * (F.col("updated_at") - lo) / (hi - lo)).otherwise(0.0)
    auto = auto.withColumn("rank_by", F.col("score") + bonus).withColumn("tier", F.lit(3)).withColumn("why", F.concat(F.format_string("semantic match %.2f", "score"), pin))
    keep = ["id", "project_id", "content", "pinned", "scope", "near", "n", "tier", "score", "rank_by", "why"]
    every = always.select(keep).unionByName(glob.select(keep)).unionByName(auto.select(keep))
    order = Window.partitionBy("tier").orderBy(F.when(F.col("tier") == 3, -F.col("rank_by")), "near", "n", "id")
    return every.withColumn("place", F.row_number().over(order)).drop("near", "n", "rank_by")


def _python(java: str) -> str:
    return java.replace("(?s)^", "(?s)\\A")


def admit(rows: list[dict], budget: int, used: int = 0, floor: float = 0.0, max_always: int = 3) -> list[dict]:
    """Candidates in order that fit the budget. The first always fits. Of always and glob ones, those that don't fit are
    skipped; the automatic tier ends with the first that doesn't. Automatic ones under the floor, unless pinned, are
    left out before. At most max_always of the first tier."""
    out, seen, always = [], set(), 0
    for r in sorted(rows, key=lambda r: (r["tier"], r["place"])):
        if r["tier"] == 3 and r["score"] < floor and not r["pinned"] or r["tier"] == 1 and always == max_always:
            continue
        cost = max(1, len(r["content"].split()) * 4 // 3)
        if r["id"] in seen or out and used + cost > budget:
            if r["tier"] == 3:
                break
            continue
        seen.add(r["id"])
        used += cost
        always += r["tier"] == 1
        out.append(r | {"tokens": cost})
    return out


def upsert(memories: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows, and of memories those without a row of that key."""
    return memories.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def settle(memories: DataFrame, row: dict, threshold: float = 0.95) -> tuple[dict, bool]:
    """(the row to write, superseded). A memory of the same project and scope whose cosine reaches the threshold
    takes the new content and embedding, and keeps its id, pin, scope and globs."""
    best = nearest(memories, row["project_id"], row["scope"], row["embedding"]).collect() if row.get("embedding") else []
    if best and best[0]["score"] >= min(max(threshold, 0.5), 0.999):
        new = best[0].asDict() | {"content": row["content"], "embedding": row["embedding"], "updated_at": row["updated_at"]}
        new.pop("score")
        return new, True
    return row, False


def as_row(memories: DataFrame, row: dict) -> DataFrame:
    return memories.sparkSession.createDataFrame([tuple(row[c] for c in memories.columns)], memories.schema)


def remember(memories: DataFrame, row: dict, threshold: float = 0.95) -> tuple[DataFrame, str, bool]:
    """(memories after the write, id, superseded); see settle."""
    new, superseded = settle(memories, row, threshold)
    return upsert(memories, as_row(memories, new)), new["id"], superseded


def reconcile(reply: str, known: list[dict]) -> tuple[str, dict | None]:
    """A model's verdict on a new fact: ('add', None), ('update' or 'noop', the known fact), or ('local', None) where it
    can't be used. Pinned facts are never updated."""
    line = next((x.strip() for x in reply.splitlines() if x.strip()), "")
    verb, _, rest = line.partition(" ")
    digits = re.search(r"\d+", rest.split()[0]) if rest.split() else None
    at = int(digits[0]) - 1 if digits else -1
    fact = known[at] if 0 <= at < len(known) else None
    match verb.upper():
        case "ADD":
            return "add", None
        case "NOOP" if fact:
            return "noop", fact
        case "UPDATE" if fact:
            return ("noop" if fact["pinned"] else "update"), fact
    return "local", None


def splice(existing: str, body: str, start: str, end: str) -> str:
    """existing with the block between the marks replaced by body, or with a block appended."""
    block = f"{start}\n{body.rstrip()}\n{end}"
    a, b = existing.find(start), existing.find(end)
    if 0 <= a < b + len(end) and b >= 0:
        out = existing[:a] + block + existing[b + len(end) :]
        return out if out.endswith("\n") else out + "\n"
    return (existing.rstrip() + "\n\n" if existing else "") + block + "\n"


def facts_of(items: list[str]) -> list[str]:
    """Distilled items without their dashes, each distinct one once."""
    return [f for f in dict.fromkeys(i.removeprefix("- ").strip() for i in items) if f]


def distil(known: list[dict], rows: list[dict], threshold: float = 0.95) -> list[dict]:
    """The memories to write for a batch of facts (rows with embeddings), one after another: a fact supersedes the nearest of
    `known` (a project's automatic memories that aren't pinned) or of the batch's own before it, as settle does."""
    threshold, out = min(max(threshold, 0.5), 0.999), {}
    pool = {m["id"]: m for m in known}
    for row in rows:
        scored = [(_cosine(m["embedding"], row["embedding"]), m["id"]) for m in pool.values()]
        near = min(scored, key=lambda x: (-x[0], x[1]), default=(0.0, None))
        new = pool[near[1]] | {k: row[k] for k in ("content", "embedding", "updated_at")} if near[1] and near[0] >= threshold else row
        pool[new["id"]] = out[new["id"]] = new
    return list(out.values())


def _cosine(a: list[float], b: list[float]) -> float:
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n and len(a) == len(b) else 0.0
