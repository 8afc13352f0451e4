"""The graph of projects, topics and sessions: nodes, edges and what of it is visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.operators import sessions as se


def nodes(sessions: DataFrame, topics: DataFrame, with_sessions: bool = True) -> DataFrame:
    """(id, kind, label, project_id)."""
    projects = sessions.select("project_id").union(topics.select(F.explode("projects"))).distinct()
    out = projects.select(F.concat(F.lit("p:"), "project_id").alias("id"), F.lit("project").alias("kind"), F.col("project_id").alias("label"), "project_id")
    out = out.unionByName(topics.select(F.concat(F.lit("t:"), "topic_id").alias("id"), F.lit("topic").alias("kind"), "label", F.element_at("projects", 1).alias("project_id")))
    if with_sessions:
        title = F.coalesce("ai_title", "first_prompt", "session_id")
        out = out.unionByName(sessions.select(F.concat(F.lit("s:"), "session_id").alias("id"), F.lit("session").alias("kind"), title.alias("label"), "project_id"))
    return out


def edges(sessions: DataFrame, topics: DataFrame, stored: DataFrame, with_sessions: bool = True) -> DataFrame:
    """(edge_id, kind, from, to, weight): stored edges with both ends among the topics, what contains what, and, with
    sessions, continuations."""
    own = topics.select("topic_id")
    out = stored.join(own.withColumnRenamed("topic_id", "a"), "a", "left_semi").join(own.withColumnRenamed("topic_id", "b"), "b", "left_semi")
    out = out.select("edge_id", "kind", F.concat(F.lit("t:"), "a").alias("from"), F.concat(F.lit("t:"), "b").alias("to"), "weight")
    held = topics.select(F.explode("projects").alias("p"), "topic_id").select(F.concat(F.lit("p:"), "p").alias("from"), F.concat(F.lit("t:"), "topic_id").alias("to"), F.lit("contains-topic").alias("kind"))
    if with_sessions:
        held = held.unionByName(sessions.select(F.concat(F.lit("p:"), "project_id").alias("from"), F.concat(F.lit("s:"), "session_id").alias("to"), F.lit("contains-session").alias("kind")))
        follow = se.continuations(sessions).select("edge_id", F.lit("session-continuation").alias("kind"), F.concat(F.lit("s:"), "a").alias("from"), F.concat(F.lit("s:"), "b").alias("to"), "weight")
        out = out.unionByName(follow)
    return out.unionByName(held.select(ids.edge_id(F.col("kind"), F.col("from"), F.col("to")).alias("edge_id"), "kind", "from", "to", F.lit(1.0).alias("weight")))


def visible(nodes: DataFrame, edges: DataFrame, search: str | None = None, kinds: list[str] | None = None, projects: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Nodes to show, of the kinds, projects and days (of a session's ended_at, where nodes have it) that are asked for.
    With a search, those whose label or id has it and their neighbours; without, sessions and what leads to them."""
    rows = nodes
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if projects is not None:
        rows = rows.where((F.col("kind") == "topic") | F.col("project_id").isin(*projects))
    if (start or end) and "ended_at" in nodes.columns:
        day = F.date_format("ended_at", "yyyy-MM-dd")
        inside = (day >= (start or "")) & (day <= (end or "9999-12-31"))
        rows = rows.where((F.col("kind") != "session") | F.col("ended_at").isNull() | inside)
    part = (search or "").strip().lower()
    links = edges.where("kind not in ('session-continuation')").select("from", "to")
    links = links.union(links.select("to", "from")).distinct()
    if part:
        hits = rows.where(F.lower("label").contains(part) | F.lower("id").contains(part)).select("id")
    else:
        hits = rows.where("kind = 'session'").select("id", "project_id")
    near = links.join(hits.select(F.col("id").alias("from")), "from", "left_semi").select(F.col("to").alias("id"))
    shown = hits.select("id").union(near)
    if not part:
        shown = shown.union(hits.select(F.concat(F.lit("p:"), "project_id")))
    return rows.join(shown.distinct(), "id", "left_semi")


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Session nodes that no edge contains, as edges from their projects."""
    alone = nodes.where("kind = 'session'").join(edges.where("kind like 'contains%'").select(F.col("to").alias("id")), "id", "left_anti")
    return alone.select(F.concat(F.lit("p:"), "project_id").alias("from"), F.col("id").alias("to"), F.lit("contains-session").alias("kind"))
