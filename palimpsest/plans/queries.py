"""Queries over the given tables, one or more for each operator, with SQL for DuckDB beside them.

The tables stand for entities: conversations for records, documents for chunks (project lang, session source),
embeddings for vectors (project label), events for recall hits and sessions (user and hour), pages' urls for paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.operators import cache, chunking, cluster, globs, graph, memory, recall
from palimpsest.operators import sessions as se
from palimpsest.plans.materialize import shared_path, stash
from palimpsest.sources import lines, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_EPS, _THRESHOLD = 0.65, 0.2
QUERY = "show me chats about the retition and therhean session in andsh"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark, sf) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("project_id"), "embedding")


def query_vector(spark, sf, vec_id: int = 7) -> list[float]:
    row = t(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def chunks(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("project_id"), F.col("source").alias("session_id"), "text", F.size(tx.words("text")).alias("token_count"), F.substring("text", 1, 80).alias("title"))


def hits(spark, sf) -> DataFrame:
    return t(spark, sf, "events").select(
        F.get_json_object("props", "$.k").cast("long").alias("chunk_id"), F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "view", "hook").otherwise(F.col("event_type")).alias("source"),
        (F.col("user_id") % 5).cast("string").alias("project_id"), F.col("ts").alias("hit_at"),
    )


def user_hours(spark, sf) -> DataFrame:
    """Sessions: a user's events in an hour."""
    e = t(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts"))
    rows = e.groupBy("user_id", "h").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("message_count"), F.max("event_type").alias("ai_title"))
    return rows.select(
        F.concat_ws("-", "user_id", F.date_format("h", "yyyyMMddHH")).alias("session_id"), (F.col("user_id") % 5).cast("string").alias("project_id"), "started_at", "ended_at", "message_count", "ai_title",
        F.lit(None).cast("string").alias("first_prompt"), F.lit(None).cast("string").alias("summary"), (F.col("user_id") % 7 == 0).alias("is_sidechain"),
    )


_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\r\n]+'), lambda w: w <> '')"
_UNIT = "list_transform({0}::DOUBLE[], lambda x: x / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])))"
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"
_COS = f"list_cosine_similarity(e.embedding::DOUBLE[], {_Q})"
_USER_HOURS = """user_hours AS (
  SELECT user_id || '-' || strftime(h, '%Y%m%d%H') AS session_id, (user_id % 5)::VARCHAR AS project_id, started_at, ended_at, message_count, ai_title, user_id % 7 = 0 AS is_sidechain
  FROM (SELECT user_id, date_trunc('hour', ts) AS h, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS message_count, max(event_type) AS ai_title FROM events GROUP BY ALL))"""
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda item, i: list_position({x}, item) = i)"


def _keywords_sql(c: str) -> str:
    parts = rf"list_filter(list_transform(list_filter(regexp_split_to_array({c}, '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 2), lambda w: lower(w)), lambda w: w NOT IN ({_STOP}))"
    return parts


# search and recall


@query(f"SELECT e.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings e ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def topk_cosine(spark, sf):
    return recall.search(vectors(spark, sf), query_vector(spark, sf), 10).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings e WHERE e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def topk_cosine_project(spark, sf):
    return recall.search(vectors(spark, sf), query_vector(spark, sf), 10, "3").select("chunk_id", F.round("score", 6).alias("score"))


def _mmr_sql(queries: str) -> str:
    """Maximal marginal relevance of each query, a pick at a time."""
    return f"""
WITH RECURSIVE unit AS (SELECT vec_id, {_UNIT.format('embedding')} AS v FROM embeddings),
pool AS (
  SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.v, list_dot_product(q.v, e.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, e.v) DESC, e.vec_id) AS n
  FROM unit q, unit e WHERE {queries} QUALIFY n <= 50
), alike AS (
  SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y, list_dot_product(a.v, b.v) AS s FROM pool a JOIN pool b ON a.query_id = b.query_id
), picks AS (
  SELECT DISTINCT query_id, 0 AS rank, []::BIGINT[] AS chosen FROM pool
  UNION ALL
  SELECT query_id, rank + 1, list_append(chosen, arg_max(chunk_id, (value, -n))) FROM (
    SELECT p.query_id, p.rank, p.chosen, c.chunk_id, c.n, 0.6::DOUBLE * c.score - 0.4::DOUBLE * coalesce(max(a.s), 0) AS value
    FROM picks p JOIN pool c ON c.query_id = p.query_id AND NOT list_contains(p.chosen, c.chunk_id)
    LEFT JOIN alike a ON a.query_id = p.query_id AND a.x = c.chunk_id AND list_contains(p.chosen, a.y)
    WHERE p.rank < 10 GROUP BY p.query_id, p.rank, p.chosen, c.chunk_id, c.n, c.score
  ) GROUP BY query_id, rank, chosen
), last AS (SELECT query_id, chosen FROM picks WHERE rank = 10), each AS (SELECT query_id, unnest(chosen) AS chunk_id, generate_subscripts(chosen, 1)::INTEGER AS rank FROM last)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM each JOIN pool USING (query_id, chunk_id)"""


@query(f"SELECT chunk_id, rank, score FROM ({_mmr_sql('q.vec_id = 7')})")
def mmr_rerank(spark, sf):
    return recall.mmr(vectors(spark, sf), query_vector(spark, sf), 10, 0.6, 50).select("chunk_id", "rank", F.round("score", 6).alias("score"))


@query(_mmr_sql("q.vec_id % 100 = 0"))
def mmr_many(spark, sf):
    """For the vectors whose id is divisible by 100, against all."""
    every = vectors(spark, sf)
    queries = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return recall.mmr_many(every, queries, 10, 0.6, 50).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_LEX = "least(1.0, list_sum(list_transform(k.keys, lambda x: CASE WHEN contains(lower(title), x) THEN 1.0::DOUBLE WHEN contains(lower(text), x) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END)) / len(k.keys))"
_PENALTY = (
    "least(0.7::DOUBLE, CASE WHEN contains(lower(text), 'initial greeting') OR contains(lower(text), 'session setup') OR contains(lower(text), 'greeting and initial') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + "
    r"CASE WHEN greets AND short THEN 0.5::DOUBLE WHEN greets THEN 0.2::DOUBLE WHEN short THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)"
)
_GREETS = rf"regexp_extract(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), '^[^\p{{L}}\p{{N}}]*([\p{{L}}\p{{N}}]+)', 1) IN ({', '.join(repr(g) for g in tx.GREETINGS)})"
_SHORT = "length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 40"
_KEYS_CTE = f"keys AS (SELECT {_distinct_in_order(_keywords_sql(repr(QUERY)))} AS keys)"


@query(f"""
WITH {_KEYS_CTE}, pool AS (
  SELECT e.vec_id AS chunk_id, {_COS} AS score FROM embeddings e ORDER BY score DESC, e.vec_id LIMIT 240
), joined AS (
  SELECT p.chunk_id, p.score, d.source AS session_id, d.text, substr(d.text, 1, 80) AS title, len({_WORDS.format('d.text')}) AS token_count, {_GREETS.replace('(text', '(d.text')} AS greets, {_SHORT.replace('(text', '(d.text')} AS short
  FROM pool p JOIN documents d ON d.doc_id = p.chunk_id
), scored AS (
  SELECT j.*, (0.4::DOUBLE * score + 0.6::DOUBLE * {_LEX}) * (1 - {_PENALTY}) AS hybrid FROM joined j, keys k
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hybrid DESC, chunk_id) AS n FROM scored WHERE hybrid >= 0.18
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY hybrid DESC, chunk_id) AS rank, sum(token_count) OVER (ORDER BY hybrid DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS used_tokens FROM capped WHERE n <= 2
)
SELECT chunk_id, session_id, rank::INTEGER AS rank, round(hybrid, 6) AS hybrid, token_count::INTEGER AS token_count, used_tokens::BIGINT AS used_tokens
FROM ranked WHERE rank <= 10 AND (rank = 1 OR used_tokens <= 4000)""")
def hybrid_recall(spark, sf):
    pool = recall.search(vectors(spark, sf), query_vector(spark, sf), 240).select("chunk_id", "score")
    own = chunks(spark, sf).join(F.broadcast(pool), "chunk_id")  # the pool is bounded; a document's title is its own
    out = recall.cap_and_pack(recall.hybrid(own, QUERY), F.col("hybrid"), recall.FLOOR, recall.PER_SESSION, 10, 4000)
    return out.select("chunk_id", "session_id", "rank", F.round("hybrid", 6).alias("hybrid"), "token_count", "used_tokens")


@query(f"SELECT count(*) AS chunk_count, coalesce(sum(len({_WORDS.format('text')})), 0)::BIGINT AS total_tokens FROM documents")
def recall_stats(spark, sf):
    return recall.stats(chunks(spark, sf))


@query(f"""
WITH d AS (SELECT doc_id AS chunk_id, source AS session_id, len({_WORDS.format('text')}) AS token_count, (n_chars % 1000) / 1000.0::DOUBLE AS s FROM documents),
capped AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, chunk_id) AS n FROM d WHERE s >= 0.18),
ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank, sum(token_count) OVER (ORDER BY s DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM capped WHERE n <= 2)
SELECT chunk_id, session_id, rank::INTEGER AS rank, used::BIGINT AS used_tokens FROM ranked WHERE rank <= 10 AND (rank = 1 OR used <= 4000)""")
def session_cap_pack(spark, sf):
    d = chunks(spark, sf).join(t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars"), "chunk_id")
    return recall.cap_and_pack(d, F.col("n_chars") % 1000 / 1000.0, 0.18, 2, 10, 4000).select("chunk_id", "session_id", "rank", "used_tokens")


@query(f"SELECT doc_id, round({_PENALTY}, 6) AS penalty FROM (SELECT doc_id, text, {_GREETS} AS greets, {_SHORT} AS short FROM documents)")
def boilerplate(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(tx.boilerplate_penalty("text"), 6).alias("penalty"))


# records and chunks


def conversation_records(spark, sf) -> DataFrame:
    """conversations as records of one text block a turn."""
    c = t(spark, sf, "conversations")
    block = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input_preview"))
    none = F.lit(None).cast("string")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") % 5).cast("string").alias("project_id"), F.col("turn").alias("turn_index"), F.col("turn").alias("line_no"), F.col("role").alias("ty"), F.concat_ws(":", "conv_id", "turn").alias("uuid"),
        none.alias("parent_uuid"), F.lit(None).cast("timestamp").alias("timestamp"), F.when(F.col("text") != "", F.array(block)).otherwise(F.array().cast(f"array<{block_type()}>")).alias("blocks"), none.alias("attachment_kind"), none.alias("attachment_text"),
        none.alias("cwd"), none.alias("git_branch"), none.alias("ai_title"), F.col("text").alias("prompt_text"), none.alias("model"),
    )


def block_type() -> str:
    return "struct<kind:string,text:string,id:string,name:string,input_preview:string>"


@query("SELECT conv_id || ':' || turn || ':0' AS chunk_id, sha256(text) AS text_sha FROM conversations WHERE role = 'user' AND text <> ''")
def chunk_user_prompts(spark, sf):
    rows = chunking.chunk(conversation_records(spark, sf)).where("role = 'user'")
    return rows.select("chunk_id", F.sha2("text", 256).alias("text_sha"))


@query(f"""
WITH w AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM documents),
s AS (SELECT doc_id, text, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 350)) AS s FROM w)
SELECT doc_id, (s // 350)::INTEGER AS piece, sha256(CASE WHEN len(w) <= 400 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 400), ' ') END) AS text_sha
FROM s WHERE s = 0 OR (len(w) > 400 AND s + 50 < len(w))""")
def chunk_windows(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(chunking.token_windows(F.col("text"))).alias("piece", "text"))
    return d.select("doc_id", "piece", F.sha2("text", 256).alias("text_sha"))


@query(r"""SELECT conv_id, turn, regexp_matches(CASE WHEN turn % 7 = 0 THEN ' <command-name>' || text ELSE text END, '^\s*<command-(name|message)>') AS is_command FROM conversations""")
def command_messages(spark, sf):
    c = t(spark, sf, "conversations").withColumn("x", F.when(F.col("turn") % 7 == 0, F.concat(F.lit(" <command-name>"), "text")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", tx.is_command("x").alias("is_command"))


def _redact_steps(columns: str) -> str:
    """CTEs s1 and on over s0 (columns, t, n): t with each kind of secret replaced in turn, n their number."""
    steps = []
    for k, (kind, pattern) in enumerate(tx.SECRETS, 1):
        p = pattern.replace("'", "''")
        steps.append(f"s{k} AS (SELECT {columns}, regexp_replace(t, '{p}', '[REDACTED:{kind}]', 'g') AS t, n + len(regexp_extract_all(t, '{p}')) AS n FROM s{k - 1})")
    return ", ".join(steps)


def _redact_sql() -> str:
    first = r"""s0 AS (SELECT doc_id, regexp_replace(text, '\btoken = "', 'access_token = "', 'g') AS t, 0 AS n FROM documents)"""
    return f"WITH {first}, {_redact_steps('doc_id')} SELECT doc_id, n::INTEGER AS redactions, sha256(t) AS text_sha FROM s{len(tx.SECRETS)}"


@query(_redact_sql())
def redact_secrets(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", tx.redact(F.regexp_replace("text", r'\btoken = "', 'access_token = "')).alias("r"))
    return d.select("doc_id", F.col("r.n").alias("redactions"), F.sha2("r.text", 256).alias("text_sha"))


@query(f"SELECT item_id, array_to_string({_distinct_in_order('k')}, ' ') AS keywords FROM (SELECT item_id, {_keywords_sql('text')} AS k FROM benchmark)")
def extract_keywords(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", F.array_join(tx.keywords("text"), " ").alias("keywords"))


@query(rf"""
WITH p AS (SELECT page_id, list_transform(regexp_split_to_array('see ' || url || ', notes.md and (src/a.py)!', '[ \t\n\r,;()"''`<>]'), lambda w: trim(w, '.:!?)([]')) AS w FROM pages),
f AS (SELECT page_id, list_filter(w, lambda x: x <> '' AND strlen(x) <= 256 AND (contains(x, '/') OR regexp_matches(x, '[^./]\.[A-Za-z0-9]{{1,8}}$'))) AS w FROM p)
SELECT page_id, array_to_string({_distinct_in_order('w')}, ' ') AS tokens FROM f""")
def path_tokens(spark, sf):
    text = F.concat(F.lit("see "), "url", F.lit(", notes.md and (src/a.py)!"))
    return t(spark, sf, "pages").select("page_id", F.array_join(tx.path_tokens(text), " ").alias("tokens"))


_PATHS_SQL = "list_transform(regexp_extract_all(url, '" + tx.PATH_PATTERN.replace("'", "''") + "'), lambda p: rtrim(p, '.,;:)\"'))"


@query(f"SELECT page_id % 7 AS topic_id, path, count(*) AS n FROM (SELECT page_id, unnest({_PATHS_SQL}) AS path FROM pages) GROUP BY ALL")
def path_counts(spark, sf):
    p = t(spark, sf, "pages").select((F.col("page_id") % 7).alias("topic_id"), F.explode(tx.path_references("url")).alias("path"))
    return p.groupBy("topic_id", "path").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) <= 280 THEN text ELSE substr(text, 1, 280) || '…' END AS preview, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS clipped FROM documents")
def previews(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.truncate("text", 280).alias("preview"), tx.clip("text", 80).alias("clipped"))


_ONE_LINE = r"array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), ' ')"


@query(rf"""
WITH l AS (SELECT doc_id, {_ONE_LINE} AS line FROM documents), h AS (SELECT doc_id, line, substr(line, 1, 80) AS head FROM l),
c AS (SELECT *, regexp_extract(head, '^(?s)(.{{8,}}?[.?!\n])', 1) AS cut FROM h)
SELECT doc_id, CASE WHEN trim(CASE WHEN cut <> '' THEN cut ELSE head END) = '' THEN '(no preview)' ELSE trim(CASE WHEN cut <> '' THEN cut ELSE head END) END AS label FROM c""")
def topic_labels(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", tx.one_line("text").alias("line"))
    return d.select("doc_id", tx.first_sentence("line").alias("label"))


# transcripts


def transcript_lines(spark, sf) -> DataFrame:
    """conversations as lines of transcripts, in JSON: prompts as strings, every seventh turn a command; answers as blocks of thinking, text and
    two tool calls; turns of other roles as two results for the answer before."""
    c = t(spark, sf, "conversations").withColumn("again", F.explode(F.when(F.col("role").isin("user", "assistant"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    own, at = F.concat_ws(":", "conv_id", "turn"), F.format_string("2025-01-%02dT%02d:%02d:00Z", 1 + F.col("turn").cast("int") % 28, F.col("conv_id").cast("int") % 24, F.col("turn").cast("int") % 60)
    said = F.when(F.col("turn") % 7 == 0, F.concat(F.lit(" <command-name>"), "text")).otherwise(F.col("text"))
    none = F.lit(None).cast("string")

    def block(kind, text=none, id_=none, name=none, path=none):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), id_.alias("id"), name.alias("name"), F.when(path.isNotNull(), F.struct(path.alias("path"))).alias("input"))

    calls = [block("tool_use", id_=F.concat(own, F.lit(n)), name=F.lit(n), path=F.concat(F.lit(f"{n.lower()}/"), F.col("conv_id").cast("string"), F.lit(".rs"))) for n in ("Read", "Grep")]
    blocks = F.array(block("thinking", F.lit("hm")), block("text", F.col("text")), *calls)
    usage = F.struct(F.coalesce(F.char_length("text"), F.lit(0)).alias("input_tokens"), F.col("turn").alias("output_tokens"))
    base = [own.alias("uuid"), at.alias("timestamp")]
    user = F.to_json(F.struct(F.lit("user").alias("type"), *base, F.struct(F.lit("user").alias("role"), said.alias("content")).alias("message")))
    assistant = F.to_json(F.struct(F.lit("assistant").alias("type"), *base, F.struct(F.lit("assistant").alias("role"), F.lit("m1").alias("model"), usage.alias("usage"), blocks.alias("content")).alias("message")))
    result = F.struct(F.lit("tool-result").alias("type"), F.when(F.col("again") == 0, F.col("text")).otherwise(F.concat(F.lit("again: "), "text")).alias("result"))
    other = F.to_json(F.struct(F.lit("attachment").alias("type"), *base, F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("parentUuid"), result.alias("attachment")))
    line = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(other)
    ids_ = [F.col("conv_id").cast("string").alias(n) for n in ("path", "session_id")]
    return c.select(*ids_, (F.col("conv_id") % 5).cast("string").alias("project_id"), (2 * F.col("turn") + F.col("again")).cast("long").alias("line_no"), F.try_parse_json(line).alias("v"))


_LINES = r"""l AS (SELECT conv_id, turn, role, text, 0 AS again FROM conversations UNION ALL SELECT conv_id, turn, role, text, 1 FROM conversations WHERE role NOT IN ('user', 'assistant')),
r AS (SELECT conv_id, turn, role, again, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, again) - 1)::INTEGER AS ti, CASE WHEN role = 'user' AND turn % 7 = 0 THEN ' <command-name>' || text WHEN again = 1 THEN 'again: ' || text ELSE text END AS text,
  (epoch(TIMESTAMP '2025-01-01') + 86400 * (turn % 28) + 3600 * (conv_id % 24) + 60 * (turn % 60))::BIGINT AS said_at FROM l)"""


@query(f"""
WITH {_LINES}
SELECT conv_id::VARCHAR AS session_id, ti AS turn_index, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'attachment' END AS ty, conv_id || ':' || turn AS uuid, CASE WHEN role NOT IN ('user', 'assistant') THEN conv_id || ':' || (turn - 1) END AS parent_uuid,
       said_at, CASE WHEN role IN ('user', 'assistant') THEN role END AS role, CASE WHEN role = 'assistant' THEN 'm1' END AS model,
       CASE WHEN role = 'assistant' THEN 'thinking,' || CASE WHEN text <> '' THEN 'text,' ELSE '' END || 'tool_use,tool_use' WHEN role = 'user' AND text <> '' THEN 'text' ELSE '' END AS kinds,
       CASE WHEN role = 'assistant' THEN '{{"path":"read/' || conv_id || '.rs"}} {{"path":"grep/' || conv_id || '.rs"}}' ELSE '' END AS inputs,
       CASE WHEN role IN ('user', 'assistant') AND text <> '' THEN sha256(text) END AS text_sha, CASE WHEN role NOT IN ('user', 'assistant') THEN sha256(text) END AS attachment_sha, CASE WHEN role = 'assistant' THEN coalesce(length(text), 0) ELSE 0 END::BIGINT AS input_tokens
FROM r""")
def record_projection(spark, sf):
    """Every line parsed and projected: what the indexer makes of a file."""
    rows = transcripts.records(transcript_lines(spark, sf))
    kinds = F.array_join(F.transform("blocks", lambda b: b["kind"]), ",")
    inputs = F.array_join(F.transform(F.filter("blocks", lambda b: b["input_preview"].isNotNull()), lambda b: b["input_preview"]), " ")
    return rows.select(
        "session_id", "turn_index", "ty", "uuid", "parent_uuid", F.unix_timestamp("timestamp").alias("said_at"), "role", "model", kinds.alias("kinds"), inputs.alias("inputs"),
        F.sha2(chunking.text_of(F.col("blocks")), 256).alias("text_sha"), F.sha2("attachment_text", 256).alias("attachment_sha"), "input_tokens",
    )


@query(rf"""
WITH {_LINES},
prompts AS (SELECT conv_id, ti, 0 AS block, 0 AS piece, 'user' AS role, CASE WHEN regexp_matches(text, '^\s*<command-(name|message)>') THEN 'command_message' ELSE 'user_prompt' END AS kind, text, NULL AS tool_name, said_at FROM r WHERE role = 'user' AND text <> ''),
w AS (SELECT conv_id, ti, text, said_at, {_WORDS.format('text')} AS w FROM r WHERE role = 'assistant' AND text <> ''),
p AS (SELECT *, unnest(generate_series(0, greatest(len(w) - 1, 0), 350)) AS s FROM w),
texts AS (SELECT conv_id, ti, 1 AS block, s // 350 AS piece, 'assistant' AS role, 'assistant_text' AS kind, CASE WHEN len(w) <= 400 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 400), ' ') END AS text, NULL AS tool_name, said_at FROM p WHERE s = 0 OR (len(w) > 400 AND s + 50 < len(w))),
results AS (SELECT conv_id, turn - 1 AS turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY again) AS k, text FROM r WHERE role NOT IN ('user', 'assistant') AND text IS NOT NULL),
calls AS (SELECT r.conv_id, r.ti, 1 + k.k AS block, 0 AS piece, 'tool_use' AS role, 'tool_call' AS kind,
  'Tool call: ' || k.name || chr(10) || 'Input: {{"path":"' || lower(k.name) || '/' || r.conv_id || '.rs"}}' || CASE WHEN x.text IS NULL THEN '' ELSE chr(10) || 'Result:' || chr(10) || CASE WHEN length(x.text) <= 4000 THEN x.text ELSE substr(x.text, 1, 4000) || '…' END END AS text, k.name AS tool_name, r.said_at
  FROM r CROSS JOIN (VALUES (1, 'Read'), (2, 'Grep')) AS k(k, name) LEFT JOIN results x ON x.conv_id = r.conv_id AND x.turn = r.turn AND x.k = k.k WHERE r.role = 'assistant'),
every AS (SELECT * FROM prompts UNION ALL SELECT * FROM texts UNION ALL SELECT * FROM calls),
s0 AS (SELECT conv_id, ti, role, kind, tool_name, said_at, row_number() OVER (PARTITION BY conv_id, ti ORDER BY block, piece) - 1 AS sub, text AS t, 0 AS n FROM every), {_redact_steps('conv_id, ti, role, kind, tool_name, said_at, sub')}
SELECT conv_id || ':' || ti || ':' || sub AS chunk_id, (conv_id % 5)::VARCHAR AS project_id, sub::INTEGER AS sub_index, role, kind, tool_name, sha256(t) AS text_sha, len({_WORDS.format('t')})::INTEGER AS token_count, n::INTEGER AS redactions, said_at FROM s{len(tx.SECRETS)}""")
def chunk_transcripts(spark, sf):
    """Chunks of whole transcripts: prompts, windows of answers, tool calls with the results that belong to them, redacted and counted."""
    rows = chunking.chunk(transcripts.records(transcript_lines(spark, sf)))
    return rows.select("chunk_id", "project_id", "sub_index", "role", "kind", "tool_name", F.sha2("text", 256).alias("text_sha"), "token_count", "redactions", F.unix_timestamp("started_at").alias("said_at"))


@query(f"""
WITH {_KEYS_CTE}, d AS (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS s, text, substr(text, 1, 80) AS title, {_GREETS} AS greets, {_SHORT} AS short FROM documents),
h AS (SELECT d.*, list_slice(list_filter(keys, lambda x: contains(lower(title), x) OR contains(lower(text), x)), 1, 4) AS hits FROM d, keys)
SELECT doc_id AS chunk_id, 'semantic ' || printf('%.2f', s) || CASE WHEN len(hits) > 0 THEN ' · keywords: ' || array_to_string(hits, ', ') ELSE '' END || CASE WHEN {_PENALTY} > 0 THEN ' · boilerplate down-weighted' ELSE '' END AS why FROM h""")
def recall_why(spark, sf):
    rows = chunks(spark, sf).join(t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 100 / 100.0).alias("score")), "chunk_id")
    return recall.hybrid(rows, QUERY).select("chunk_id", "why")


# analytics


@query(r"""
SELECT conv_id::VARCHAR AS session_id, (conv_id % 5)::VARCHAR AS project_id, count(*) FILTER (role = 'user') AS user_count, count(*) FILTER (role = 'assistant') AS assistant_count, count(*) FILTER (role IN ('user', 'assistant')) AS message_count,
       CASE WHEN length(arg_min(text, turn) FILTER (role = 'user')) <= 280 THEN arg_min(text, turn) FILTER (role = 'user') ELSE substr(arg_min(text, turn) FILTER (role = 'user'), 1, 280) || '…' END AS first_prompt
FROM conversations GROUP BY conv_id""")
def session_rollup(spark, sf):
    return se.rollup(conversation_records(spark, sf)).select("session_id", "project_id", "user_count", "assistant_count", "message_count", "first_prompt")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant' AND text <> '') AS last_text FROM conversations GROUP BY conv_id")
def last_assistant_text(spark, sf):
    c = t(spark, sf, "conversations").withColumn("said", F.when(F.col("role") == "assistant", F.col("text")))
    return c.groupBy("conv_id").agg(se.last_filled("said", "turn").alias("last_text"))


@query("SELECT user_id::VARCHAR AS session_id, event_type AS model, sum(floor(value)::BIGINT)::BIGINT AS input_tokens, sum(floor(value * 2)::BIGINT)::BIGINT AS output_tokens, 0::BIGINT AS cache_read_tokens, count(*)::BIGINT AS cache_creation_tokens FROM events GROUP BY user_id, event_type")
def usage_by_model(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.lit("assistant").alias("ty"), F.col("event_type").alias("model"), F.floor("value").alias("input_tokens"), F.floor(F.col("value") * 2).alias("output_tokens"), F.lit(None).cast("long").alias("cache_read_tokens"), F.lit(1).alias("cache_creation_tokens"))
    return se.usage(e)


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def type_histogram(spark, sf):
    return se.type_histogram(t(spark, sf, "events").select(F.col("event_type").alias("ty")))


@query("SELECT CASE WHEN role = 'tool' THEN '<missing>' ELSE role || '-x' END AS type, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY 1")
def unknown_types(spark, sf):
    c = t(spark, sf, "conversations").select(F.when(F.col("role") == "user", "user").when(F.col("role") == "tool", "").otherwise(F.concat("role", F.lit("-x"))).alias("ty"))
    return se.type_histogram(c, unknown=True)


@query(f"WITH {_USER_HOURS} SELECT project_id, count(*) AS session_count, max(ended_at) AS last_seen FROM user_hours GROUP BY project_id")
def project_summary(spark, sf):
    return se.project_summary(user_hours(spark, sf))


@query(f"WITH {_USER_HOURS} SELECT project_id, count(*) AS session_count, max(ended_at) AS last_seen FROM user_hours GROUP BY project_id ORDER BY last_seen DESC, project_id LIMIT 1")
def recent_project(spark, sf):
    return se.recent_project(user_hours(spark, sf))


@query(f"WITH {_USER_HOURS} SELECT session_id, ended_at FROM user_hours WHERE project_id = '2' ORDER BY ended_at DESC, session_id LIMIT 50")
def recent_sessions(spark, sf):
    return se.recent(user_hours(spark, sf), "2").select("session_id", "ended_at")


@query(f"WITH {_USER_HOURS} SELECT session_id, message_count FROM user_hours WHERE NOT is_sidechain AND message_count >= 2 ORDER BY ended_at DESC, session_id LIMIT 20")
def unsummarized_sessions(spark, sf):
    doubled = user_hours(spark, sf).withColumn("message_count", F.col("message_count") * 2)  # so that some reach four
    return se.unsummarized(doubled).select("session_id", (F.col("message_count") / 2).cast("long").alias("message_count"))


@query(f"WITH {_USER_HOURS} SELECT session_id FROM user_hours WHERE contains(lower(ai_title), 'err')")
def sessions_by_title(spark, sf):
    return se.titled(user_hours(spark, sf), "Err").select("session_id")


@query(f"""
WITH {_USER_HOURS}, n AS (
  SELECT project_id, session_id AS a, ended_at, lead(session_id) OVER w AS b, lead(started_at) OVER w AS nxt FROM user_hours WHERE NOT is_sidechain WINDOW w AS (PARTITION BY project_id ORDER BY started_at, session_id)
), g AS (SELECT *, date_sub('minute', ended_at, nxt) AS gap FROM n WHERE b IS NOT NULL)
SELECT substr(sha256('session-continuation:' || a || ':' || b), 1, 16) AS edge_id, project_id, a, b, gap::BIGINT AS gap_minutes, round(1 - 0.75 * gap / 30, 6)::DOUBLE AS weight, 'resumed ' || gap || 'm after the previous session ended' AS evidence
FROM g WHERE gap BETWEEN 0 AND 30""")
def session_continuation(spark, sf):
    return se.continuations(user_hours(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("""
WITH h AS (SELECT (props->>'$.k')::BIGINT AS chunk_id, user_id FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-20' AND user_id % 5 = 1)
SELECT chunk_id, count(DISTINCT user_id) AS distinct_sessions, sha256(text) AS text_sha FROM h JOIN documents ON doc_id = chunk_id GROUP BY chunk_id, text HAVING count(DISTINCT user_id) >= 4 ORDER BY distinct_sessions DESC, chunk_id LIMIT 12""")
def hot_chunks(spark, sf):
    out = se.hot_chunks(hits(spark, sf), chunks(spark, sf), "1", F.lit("2024-01-20").cast("timestamp"), 4)
    return out.select("chunk_id", "distinct_sessions", F.sha2("text", 256).alias("text_sha"))


@query(r"""
WITH l AS (SELECT conv_id, turn, role || ': ' || text || chr(10) || chr(10) AS line FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''),
w AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS b FROM l)
SELECT conv_id::VARCHAR AS session_id, sha256(coalesce(string_agg(line, '' ORDER BY turn) FILTER (b <= 3000), '') || CASE WHEN bool_or(b > 3000) THEN '[…transcript truncated at max_chars…]' ELSE '' END) AS transcript_sha FROM w GROUP BY conv_id""")
def transcript_render(spark, sf):
    c = t(spark, sf, "conversations").where("role in ('user', 'assistant') and text <> ''")
    return se.transcript(_turns(c), 3000).select("session_id", F.sha2("transcript", 256).alias("transcript_sha"))


def _turns(c: DataFrame) -> DataFrame:
    tool = F.when(F.col("role") == "tool_use", "Read")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), F.lit(0).alias("sub_index"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), "role", "text", tool.alias("tool_name"))


@query(r"""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'tool_use' ELSE role END AS role, text FROM conversations)
SELECT conv_id::VARCHAR AS session_id, sha256('Transcript:' || chr(10) || chr(10) || string_agg(CASE WHEN role = 'tool_use' THEN '[tool_use: Read]' ELSE '[' || role || ']' END || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn)) AS prompt_sha,
       sha256(unhex(sha256('m1' || chr(10) || string_agg(conv_id || ':' || turn || '|' || text || chr(10), '' ORDER BY turn)))) AS input_hash FROM c GROUP BY conv_id""")
def summary_prompts(spark, sf):
    c = _turns(t(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 2, "tool_use").otherwise(F.col("role"))))
    prompts = se.render(c).select("session_id", F.sha2("prompt", 256).alias("prompt_sha"))
    return prompts.join(se.input_hashes(c, "m1"), "session_id")


@query("""
WITH s AS (SELECT (conv_id % 5)::VARCHAR AS project_id, conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY ALL)
SELECT project_id, count(*) AS sessions, sum(n)::BIGINT AS records, sum(u)::BIGINT AS user_records FROM s GROUP BY ROLLUP (project_id)""")
def doctor_report(spark, sf):
    return se.doctor(conversation_records(spark, sf), None)


# ids


@query("SELECT label, substr(sha256(string_agg(vec_id::VARCHAR || chr(10), '' ORDER BY vec_id::VARCHAR)), 1, 16) AS topic_id FROM embeddings GROUP BY label")
def topic_ids(spark, sf):
    return t(spark, sf, "embeddings").groupBy("label").agg(ids.topic_id(F.collect_list(F.col("vec_id").cast("string"))).alias("topic_id"))


@query("SELECT doc_id, substr(sha256('contains-session:' || lang || ':' || source), 1, 16) AS edge_id, replace('/' || lang || '/' || source, '/', '-') AS project FROM documents")
def edge_ids(spark, sf):
    return t(spark, sf, "documents").select("doc_id", ids.edge_id(F.lit("contains-session"), F.col("lang"), F.col("source")).alias("edge_id"), ids.project_id(F.concat(F.lit("/"), "lang", F.lit("/"), "source")).alias("project"))


@query("SELECT conv_id::VARCHAR AS session_id, sha256(unhex(sha256('m1' || chr(10) || string_agg(conv_id || ':' || turn || ':0|' || text || chr(10), '' ORDER BY turn)))) AS input_hash FROM conversations GROUP BY conv_id")
def input_hash(spark, sf):
    """Of each conversation as a session: as much as a session has is hashed at once."""
    c = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), F.lit(0).alias("sub_index"), F.concat_ws(":", "conv_id", "turn", F.lit(0)).alias("chunk_id"), "text")
    return se.input_hashes(c, "m1")


# topics and the graph

_PAIRS = f"pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id < y.vec_id WHERE 1 - list_dot_product(x.u, y.u) <= {_EPS})"
_UNITS = f"unit AS (SELECT vec_id, label, {_UNIT.format('embedding')} AS u FROM embeddings)"


@query(f"""
WITH RECURSIVE {_UNITS}, {_PAIRS}, twice AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
core AS (SELECT a FROM twice GROUP BY a HAVING count(*) + 1 >= 4),
link AS (SELECT twice.a, twice.b FROM twice SEMI JOIN core c1 ON twice.a = c1.a SEMI JOIN core c2 ON twice.b = c2.a),
reach AS (SELECT a AS node, a AS root FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
named AS (SELECT node, min(root) AS cluster FROM reach GROUP BY node),
border AS (SELECT twice.a AS node, min(named.cluster) AS cluster FROM twice JOIN named ON named.node = twice.b WHERE twice.a NOT IN (SELECT a FROM core) GROUP BY twice.a)
SELECT node AS chunk_id, cluster FROM named UNION ALL SELECT node, cluster FROM border""")
def dbscan_topics(spark, sf):
    v = vectors(spark, sf).withColumn("project_id", F.lit("all"))
    return cluster.dbscan(v, _EPS).select("chunk_id", "cluster")


_CENTRES = """mean AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
centres AS (SELECT label, list(x / n ORDER BY i) AS c FROM (SELECT label, i, x, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM mean) GROUP BY label)"""


@query(f"WITH {_CENTRES} SELECT label::VARCHAR AS project_id, unnest(list_transform(c, lambda x: round(x, 6))) AS x, generate_subscripts(c, 1)::INTEGER - 1 AS pos FROM centres")
def topic_centroids(spark, sf):
    return cluster.centroids(vectors(spark, sf), "project_id").select("project_id", F.posexplode(F.transform("centroid", lambda x: F.round(x, 6))).alias("pos", "x"))


@query(f"WITH {_CENTRES} SELECT label::VARCHAR AS project_id, arg_max(vec_id, s) AS chunk_id, round(max(s), 6) AS score FROM (SELECT e.label, vec_id, list_dot_product(embedding::DOUBLE[], c) AS s FROM embeddings e JOIN centres USING (label)) GROUP BY label")
def central_member(spark, sf):
    v = vectors(spark, sf)
    return cluster.central(v, "project_id", cluster.centroids(v, "project_id")).withColumn("score", F.round("score", 6))


@query(rf"""
WITH {_CENTRES}, scored AS (SELECT e.label, vec_id, list_dot_product(embedding::DOUBLE[], c) AS s FROM embeddings e JOIN centres USING (label)),
best AS (SELECT label, arg_min(vec_id, (-s, vec_id)) AS vec_id FROM scored GROUP BY label),
line AS (SELECT label, {_ONE_LINE} AS line FROM best JOIN documents ON doc_id = vec_id), h AS (SELECT *, substr(line, 1, 80) AS head FROM line), c AS (SELECT *, regexp_extract(head, '^(?s)(.{{8,}}?[.?!\n])', 1) AS cut FROM h),
said AS (SELECT label, CASE WHEN trim(CASE WHEN cut <> '' THEN cut ELSE head END) = '' THEN '(no preview)' ELSE trim(CASE WHEN cut <> '' THEN cut ELSE head END) END AS name, CASE WHEN length(line) <= 240 THEN line ELSE substr(line, 1, 239) || '…' END AS description FROM c),
members AS (SELECT label, list_sort(list(vec_id::VARCHAR)) AS m, list_sort(list(DISTINCT (vec_id % 9)::VARCHAR)) AS sessions FROM embeddings GROUP BY label)
SELECT substr(sha256(array_to_string(m, chr(10)) || chr(10)), 1, 16) AS topic_id, len(m)::INTEGER AS size, sha256(array_to_string(m, ' ')) AS members_sha, array_to_string(sessions, ' ') AS sessions, members.label::VARCHAR AS projects, name AS label, description
FROM members LEFT JOIN said USING (label)""")
def topic_build(spark, sf):
    """A topic of each label: members, sessions and projects as sets, and what the most central member says."""
    v = vectors(spark, sf).withColumn("session_id", (F.col("chunk_id") % 9).cast("string"))
    out = cluster.topics(v, v.select("chunk_id", F.col("project_id").alias("cluster")), chunks(spark, sf))
    return out.select("topic_id", "size", F.sha2(F.array_join("members", " "), 256).alias("members_sha"), F.array_join("sessions", " ").alias("sessions"), F.array_join("projects", " ").alias("projects"), "label", "description")


_SIM = f"""{_CENTRES}, p AS (SELECT x.label::VARCHAR AS a, y.label::VARCHAR AS b, list_dot_product(x.c, y.c) AS s FROM centres x JOIN centres y ON x.label::VARCHAR < y.label::VARCHAR WHERE list_dot_product(x.c, y.c) >= {_THRESHOLD}),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, CASE WHEN f = a THEN b ELSE a END) AS n FROM (SELECT a, b, s, a AS f FROM p UNION ALL SELECT a, b, s, b FROM p)),
sim AS (SELECT DISTINCT substr(sha256('topic-similarity:' || a || ':' || b), 1, 16) AS edge_id, a, b, round(s, 6) AS cosine, round(least(greatest((s - {_THRESHOLD}) / (1 - {_THRESHOLD}), 0), 1), 6)::DOUBLE AS weight FROM r WHERE n <= 5)"""


@query(f"WITH {_SIM} SELECT edge_id, a, b, cosine, weight FROM sim")
def topic_similarity_edges(spark, sf):
    c = cluster.centroids(vectors(spark, sf), "project_id").withColumnRenamed("project_id", "topic_id")
    return cluster.similarity_edges(c, _THRESHOLD).select("edge_id", "a", "b", F.round("cosine", 6).alias("cosine"), F.round("weight", 6).alias("weight"))


@query(r"""
WITH p AS (SELECT (page_id % 7)::VARCHAR AS topic_id, regexp_extract(url, '\.(example\.[a-z]+/[a-z]+)/', 1) AS path FROM pages), c AS (SELECT topic_id, path FROM p GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT x.topic_id AS a, y.topic_id AS b, count(*) AS shared, array_to_string(list_slice(list(x.path ORDER BY x.path), 1, 5), ' ') AS evidence FROM c x JOIN c y ON x.path = y.path AND x.topic_id < y.topic_id GROUP BY ALL)
SELECT substr(sha256('shared-file:' || a || ':' || b), 1, 16) AS edge_id, a, b, shared, least(shared / 5, 1)::DOUBLE AS weight, evidence FROM e""")
def shared_file_edges(spark, sf):
    p = t(spark, sf, "pages").select((F.col("page_id") % 7).cast("string").alias("topic_id"), F.regexp_extract("url", r"\.(example\.[a-z]+/[a-z]+)/", 1).alias("path"))
    return cluster.shared_file_edges(p).withColumn("evidence", F.array_join("evidence", " "))


@query(f"""
WITH x AS (SELECT e.label::VARCHAR AS project_id, e.vec_id, CASE WHEN e.vec_id % 3 = 0 THEN e.vec_id % 6 END AS cluster FROM embeddings e)
SELECT project_id, count(DISTINCT cluster) AS topics, count(cluster) AS clustered, count(*) FILTER (cluster IS NULL) AS ungrouped FROM x GROUP BY ROLLUP (project_id)""")
def cluster_report(spark, sf):
    v = vectors(spark, sf)
    return cluster.report(v, v.where("chunk_id % 3 = 0").select("chunk_id", (F.col("chunk_id") % 6).alias("cluster")))


def graph_topics(spark, sf) -> DataFrame:
    return t(spark, sf, "embeddings").groupBy("label").agg(F.array_sort(F.collect_set((F.col("vec_id") % 5).cast("string"))).alias("projects")).select(F.col("label").cast("string").alias("topic_id"), F.concat(F.lit("topic "), "label").alias("label"), "projects")


_TOPICS = "topics AS (SELECT label::VARCHAR AS topic_id, 'topic ' || label AS label, list_sort(list(DISTINCT (vec_id % 5)::VARCHAR)) AS projects FROM embeddings GROUP BY embeddings.label)"
_NODES = """nodes AS (
  SELECT 'p:' || project_id AS id, 'project' AS kind, project_id AS label, project_id FROM (SELECT project_id FROM user_hours UNION SELECT unnest(projects) FROM topics)
  UNION ALL SELECT 't:' || topic_id, 'topic', label, projects[1] FROM topics UNION ALL SELECT 's:' || session_id, 'session', ai_title, project_id FROM user_hours)"""
_EDGES = f"""n AS (SELECT project_id, session_id AS a, ended_at, lead(session_id) OVER w AS b, lead(started_at) OVER w AS nxt FROM user_hours WHERE NOT is_sidechain WINDOW w AS (PARTITION BY project_id ORDER BY started_at, session_id)),
held AS (SELECT 'p:' || unnest(projects) AS f, 't:' || topic_id AS g, 'contains-topic' AS kind FROM topics UNION ALL SELECT 'p:' || project_id, 's:' || session_id, 'contains-session' FROM user_hours),
edges AS (
  SELECT edge_id, 'topic-similarity' AS kind, 't:' || a AS "from", 't:' || b AS "to", weight FROM sim
  UNION ALL SELECT substr(sha256('session-continuation:' || a || ':' || b), 1, 16), 'session-continuation', 's:' || a, 's:' || b, round(1 - 0.75 * date_sub('minute', ended_at, nxt) / 30, 6)::DOUBLE FROM n WHERE b IS NOT NULL AND date_sub('minute', ended_at, nxt) BETWEEN 0 AND 30
  UNION ALL SELECT substr(sha256(kind || ':' || f || ':' || g), 1, 16), kind, f, g, 1.0 FROM held)"""


@query(f"WITH {_USER_HOURS}, {_TOPICS}, {_NODES} SELECT id, kind, label, project_id FROM nodes")
def graph_nodes(spark, sf):
    return graph.nodes(user_hours(spark, sf), graph_topics(spark, sf))


def stored_edges(spark, sf) -> DataFrame:
    return topic_similarity_edges(spark, sf).withColumn("kind", F.lit("topic-similarity"))


@query(f"WITH {_USER_HOURS}, {_TOPICS}, {_SIM}, {_EDGES} SELECT edge_id, kind, \"from\", \"to\", weight FROM edges")
def graph_edges(spark, sf):
    return graph.edges(user_hours(spark, sf), graph_topics(spark, sf), stored_edges(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_USER_HOURS}, {_TOPICS}, {_NODES}, {_SIM}, {_EDGES}, hit AS (SELECT id FROM nodes WHERE contains(lower(label), 'topic 3')),
near AS (SELECT id FROM hit UNION SELECT "to" FROM edges WHERE kind <> 'session-continuation' AND "from" IN (SELECT id FROM hit) UNION SELECT "from" FROM edges WHERE kind <> 'session-continuation' AND "to" IN (SELECT id FROM hit))
SELECT id, kind FROM nodes WHERE id IN (SELECT id FROM near)""")
def graph_search_1hop(spark, sf):
    sessions, topics = user_hours(spark, sf), graph_topics(spark, sf)
    return graph.visible(graph.nodes(sessions, topics), graph.edges(sessions, topics, stored_edges(spark, sf)), "topic 3").select("id", "kind")


@query(f"""WITH {_USER_HOURS}, {_TOPICS}, {_NODES}, shown AS (SELECT session_id, project_id FROM user_hours WHERE project_id IN ('1', '2') AND ended_at >= TIMESTAMP '2024-01-05' AND ended_at < TIMESTAMP '2024-01-08')
SELECT id, kind FROM nodes WHERE id IN (SELECT 's:' || session_id FROM shown) OR id IN (SELECT 'p:' || project_id FROM shown)""")
def graph_visible(spark, sf):
    sessions, topics = user_hours(spark, sf), graph_topics(spark, sf)
    ended = sessions.select(F.concat(F.lit("s:"), "session_id").alias("id"), "ended_at")
    nodes = graph.nodes(sessions, topics).join(ended, "id", "left")
    return graph.visible(nodes, graph.edges(sessions, topics, stored_edges(spark, sf)), None, None, ["1", "2"], "2024-01-05", "2024-01-07").select("id", "kind")


@query(f"WITH {_USER_HOURS}, {_TOPICS}, {_NODES} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def graph_kind_counts(spark, sf):
    return graph.counts(graph_nodes(spark, sf))


@query(f"WITH {_USER_HOURS}, {_TOPICS}, {_NODES}, {_SIM}, {_EDGES} SELECT 'p:' || project_id AS \"from\", id AS \"to\" FROM nodes WHERE kind = 'session' AND id NOT IN (SELECT \"to\" FROM edges WHERE kind LIKE 'contains%' AND \"from\" <> 'p:3')")
def graph_orphans(spark, sf):
    sessions, topics = user_hours(spark, sf), graph_topics(spark, sf)
    edges = graph.edges(sessions, topics, stored_edges(spark, sf)).where("from <> 'p:3'")  # as if one project's edges were lost
    return graph.orphans(graph.nodes(sessions, topics), edges).select("from", "to")


@query("SELECT (user_id % 5)::VARCHAR AS project_id, arg_max(event_type, ts) FILTER (event_type <> 'view') AS cwd FROM events GROUP BY 1")
def project_cwd(spark, sf):
    e = t(spark, sf, "events").select((F.col("user_id") % 5).cast("string").alias("project_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("cwd"))
    return se.project_cwd(e)


@query(f"SELECT doc_id, greatest(1, len({_WORDS.format('text')}) * 4 // 3)::INTEGER AS tokens FROM documents")
def memory_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.estimate_tokens("text").alias("tokens"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cosine, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS dot FROM embeddings")
def vector_products(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vx.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"), F.round(vx.dot(F.col("embedding"), F.reverse("embedding")), 6).alias("dot"))


# memories


def memories(spark, sf) -> DataFrame:
    """All documents as memories of projects 0, 1, 2 and the global one, in all scopes, with their vectors where they have one."""
    d = t(spark, sf, "documents").join(t(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    project = F.when(F.col("doc_id") % 4 == 3, memory.GLOBAL).otherwise((F.col("doc_id") % 4).cast("string"))
    scope = F.element_at(F.array(*map(F.lit, ("auto", "auto", "always", "glob", "manual"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), project.alias("project_id"), F.col("text").alias("content"), F.lit("agent").alias("source"), (F.col("doc_id") % 11 == 0).alias("pinned"), scope.alias("scope"),
        F.when(scope == "glob", F.array(F.concat(F.lit("**/"), "lang", F.lit("/*.py")))).alias("globs"), F.col("doc_id").alias("created_at"), (F.col("n_chars") * 10 + F.col("doc_id") % 10).alias("updated_at"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


_MEMORIES = """m AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS id, CASE WHEN doc_id % 4 = 3 THEN '__global__' ELSE (doc_id % 4)::VARCHAR END AS project_id, text AS content, doc_id % 11 = 0 AS pinned,
  (['auto', 'auto', 'always', 'glob', 'manual'])[doc_id % 5 + 1] AS scope, lang, n_chars * 10 + doc_id % 10 AS updated_at, embedding::DOUBLE[] AS embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""
_MCOS = f"list_cosine_similarity(embedding, {_Q})"


@query(f"WITH {_MEMORIES} SELECT id, pinned, updated_at FROM m WHERE project_id = '1' AND scope = 'auto' ORDER BY pinned DESC, updated_at DESC, id LIMIT 100")
def memory_list(spark, sf):
    return memory.list_memories(memories(spark, sf), "1", "auto").select("id", "pinned", "updated_at")


@query(f"WITH {_MEMORIES} SELECT id, project_id FROM m WHERE project_id = '2' OR project_id = '__global__'")
def memory_with_global(spark, sf):
    return memory.with_global(memories(spark, sf), "2", None).select("id", "project_id")


@query(f"WITH {_MEMORIES} SELECT id, round({_MCOS}, 6) AS score FROM m WHERE project_id = '1' AND scope = 'auto' AND embedding IS NOT NULL ORDER BY {_MCOS} DESC, id LIMIT 10")
def memory_search(spark, sf):
    return memory.search(memories(spark, sf), "1", query_vector(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_MEMORIES} SELECT id, round({_MCOS}, 6) AS score FROM m WHERE project_id = '2' AND scope = 'manual' AND NOT pinned AND embedding IS NOT NULL ORDER BY {_MCOS} DESC, id LIMIT 1")
def memory_nearest(spark, sf):
    return memory.nearest(memories(spark, sf), "2", "manual", query_vector(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"""
WITH {_MEMORIES}, o AS (SELECT *, (project_id <> '1')::INTEGER AS near, row_number() OVER (PARTITION BY project_id, scope ORDER BY pinned DESC, updated_at DESC, id) AS n FROM m WHERE project_id IN ('1', '__global__')),
always AS (SELECT 1 AS tier, id, 1.0::DOUBLE AS score, 0.0::DOUBLE AS by_, near, n FROM o WHERE scope = 'always' AND n <= 3),
globs AS (SELECT 2 AS tier, id, 0.9::DOUBLE AS score, 0.0::DOUBLE AS by_, near, n FROM o WHERE scope = 'glob' AND n <= 50 AND lang = 'en'),
a0 AS (SELECT *, {_MCOS} AS score, row_number() OVER (PARTITION BY project_id ORDER BY {_MCOS} DESC, id) AS k FROM o WHERE scope = 'auto' AND embedding IS NOT NULL),
a1 AS (SELECT *, min(updated_at) OVER () AS lo, max(updated_at) OVER () AS hi FROM a0 WHERE k <= 5),
auto AS (SELECT 3 AS tier, id, score, -(score + CASE WHEN hi > lo THEN 0.03::DOUBLE * (updated_at - lo) / (hi - lo) ELSE 0 END) AS by_, near, k AS n FROM a1),
every AS (SELECT * FROM always UNION ALL SELECT * FROM globs UNION ALL SELECT * FROM auto)
SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY by_, near, n, id)::INTEGER AS place, id, round(score, 6) AS score FROM every""")
def memory_tiers(spark, sf):
    out = memory.candidates(memories(spark, sf), "1", "look at src/en/main.py", query_vector(spark, sf))
    return out.select("tier", "place", "id", F.round("score", 6).alias("score"))


@query(f"""
WITH {_MEMORIES}, c AS (SELECT x.id AS id, y.id AS other, list_cosine_similarity(x.embedding, y.embedding) AS s FROM m x JOIN m y ON x.project_id = y.project_id AND x.scope = y.scope AND x.id <> y.id WHERE NOT y.pinned AND y.scope = 'manual' AND x.embedding IS NOT NULL AND y.embedding IS NOT NULL)
SELECT id, arg_max(other, s) AS supersedes, round(max(s), 6) AS score FROM c GROUP BY id""")
def supersede_candidates(spark, sf):
    """For each manual memory with a vector the nearest one of its project that it would supersede."""
    m = memories(spark, sf).where("scope = 'manual' and embedding is not null").select("id", "project_id", "embedding", "pinned")
    found = cluster.nearest_of_group(m.drop("pinned"), m.where("not pinned").drop("pinned"), "project_id")
    return found.select("id", F.col("nearest").alias("supersedes"), F.round("score", 6).alias("score"))


# caches and merges


@query("""
WITH c AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang = 'en')
SELECT count(*) FILTER (c.hash IS NOT NULL) AS hits, count(*) FILTER (c.hash IS NULL) AS misses, count(DISTINCT d.h) FILTER (c.hash IS NULL) AS to_embed FROM (SELECT sha256(text) AS h FROM documents) d LEFT JOIN c ON c.hash = d.h""")
def embed_cache_hits_misses(spark, sf):
    """All documents against a cache of the English ones' texts."""
    d = t(spark, sf, "documents").select("doc_id", "lang", "text")
    known = d.where("lang = 'en'").select(F.sha2("text", 256).alias("hash"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["hash"])
    looked = cache.cached(d, known)
    return looked.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.countDistinct(F.when(~F.col("hit"), F.col("hash"))).alias("to_embed"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE NOT (source IN ('src1', 'src2', 'src3') AND doc_id % 3 <> 1)")
def prune_keepset(spark, sf):
    c = chunks(spark, sf)
    current = c.where("session_id in ('src1', 'src2', 'src3') and chunk_id % 3 = 1").select("session_id", "chunk_id")
    return cache.prune(c, current).select("chunk_id")


@query("""
WITH n AS (SELECT doc_id, source, n_chars + 1 AS n FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, n FROM n UNION ALL SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 3 <> 0""")
def upsert_rows(spark, sf):
    old = t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n"))
    return cache.merge(old, old.where("doc_id % 3 = 0").withColumn("n", F.col("n") + 1), ["doc_id"])


@query(r"SELECT page_id, regexp_matches(regexp_replace(url, '^https?://', ''), '(?s)^(?:.*/)?example\.(?:com|org)/.*\.html$') OR regexp_matches(regexp_extract(regexp_replace(url, '^https?://', ''), '([^/]*)$', 1), '^[0-9]...*$') AS fits FROM pages")
def glob_matches(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    return t(spark, sf, "pages").select("page_id", tx.glob_match(F.array(bare), ["**/example.{com,org}/*.html", "[0-9]??*", "[bad"]).alias("fits"))


_PATHS = r"""p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages WHERE url IS NOT NULL),
s AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^([^/]*)/', 1) AS host, regexp_extract(path, '^[^/]*/([^/]*)/', 1) AS part FROM p),
g AS (SELECT DISTINCT page_id % 4 AS kind, CASE page_id % 4 WHEN 0 THEN name WHEN 1 THEN host WHEN 2 THEN right(path, 4) ELSE part END AS x FROM s
      WHERE regexp_matches(path, '^[A-Za-z0-9._/-]+$') AND CASE page_id % 4 WHEN 0 THEN name WHEN 1 THEN host WHEN 2 THEN 'x' ELSE part END <> '')"""


@query(f"""
WITH {_PATHS}, paths AS (SELECT DISTINCT path, name FROM s)
SELECT CASE kind WHEN 0 THEN '**/' || x WHEN 1 THEN x || '/*' WHEN 2 THEN '*' || x ELSE '**/' || x || '/*' END AS pattern, count(*) AS paths
FROM g JOIN paths ON CASE kind WHEN 0 THEN name = x WHEN 1 THEN starts_with(path, x || '/') WHEN 2 THEN ends_with(path, x) ELSE starts_with(path, x || '/') OR contains(path, '/' || x || '/') END GROUP BY ALL""")
def glob_index(spark, sf):
    """How many of all pages' paths each of the patterns fits that are made of them: of names, hosts, ends and parts."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    s = t(spark, sf, "pages").where("url is not null").select("page_id", path.alias("path"))
    name, host, part = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_extract("path", "^([^/]*)/", 1), F.regexp_extract("path", "^[^/]*/([^/]*)/", 1)
    kind = F.col("page_id") % 4
    made = F.when((kind == 0) & (name != ""), F.concat(F.lit("**/"), name)).when((kind == 1) & (host != ""), F.concat(host, F.lit("/*"))).when(kind == 2, F.concat(F.lit("*"), F.right("path", F.lit(4))))
    made = made.when((kind == 3) & (part != ""), F.concat(F.lit("**/"), part, F.lit("/*")))
    patterns = s.where(F.col("path").rlike("^[A-Za-z0-9._/-]+$")).select(made.alias("pattern"))
    return globs.matches(s, patterns).groupBy("pattern").agg(F.count("*").alias("paths"))


# lines by bytes

_CLEAN = r"regexp_replace(text, '[\x00-\x1f\x7f\x22\x5c]', '', 'g')"
_LINE = f"""CASE (conv_id + turn) % 10 WHEN 0 THEN '123456789' WHEN 1 THEN '{{"turn":' || turn WHEN 2 THEN '' ELSE '{{"turn":' || turn || ',"text":"' || {_CLEAN} || '"}}' END"""


@query(f"""
SELECT role, (count(*) FILTER ((conv_id + turn) % 10 <> 2))::BIGINT AS total_lines, (count(*) FILTER ((conv_id + turn) % 10 < 2))::BIGINT AS bad_lines, (count(*) FILTER ((conv_id + turn) % 10 = 0))::BIGINT AS not_utf8,
  count(*)::BIGINT AS newlines, sum(strlen({_LINE}) + 1)::BIGINT AS bytes, (count(*) FILTER ((conv_id + turn) % 10 <> 2))::BIGINT AS numbers, coalesce(sum(turn) FILTER ((conv_id + turn) % 10 > 2), 0)::BIGINT AS turns
FROM conversations GROUP BY role""")
def line_scan(spark, sf):
    """All conversations written as lines of JSON, of which some hold a byte that isn't UTF-8, are cut or are blank, and read by bytes in ranges of 64 KB."""
    c = t(spark, sf, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 10
    turn = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"))
    good = F.concat(turn, F.lit(',"text":"'), F.regexp_replace("text", r"[\x00-\x1f\x7f\x22\x5c]", ""), F.lit('"}'))
    bad = F.concat(F.lit('{"x":"'), F.unhex(F.lit("FF")).cast("string"), F.lit('"}'))
    path = shared_path(spark, "line-scan")
    c.select("role", F.when(kind == 0, bad).when(kind == 1, turn).when(kind == 2, "").otherwise(good).alias("value")).write.partitionBy("role").text(path)
    files = transcripts.listed(spark, path, "*.txt").select("path", "length", F.regexp_extract("path", "role=([^/]*)/", 1).alias("project_id"), F.lit("").alias("session_id"))
    scanned = stash(transcripts.scan(files, 1 << 16), "scanned")
    parsed = transcripts.parse(scanned, files)
    counts = parsed.groupBy(F.col("project_id").alias("role")).agg(F.count("*").alias("total_lines"), F.count_if(F.col("v").isNull()).alias("bad_lines"), F.countDistinct("path", "line_no").alias("numbers"), F.coalesce(F.sum(F.try_variant_get("v", "$.turn", "long").cast("long") * (F.try_variant_get("v", "$.text", "string").isNotNull()).cast("long")), F.lit(0)).alias("turns"))
    role = F.regexp_extract("path", "role=([^/]*)/", 1).alias("role")
    read = scanned.groupBy(role).agg(F.count_if(F.col("line").isNotNull() & lines.valid().isNull()).alias("not_utf8"), F.sum("lines").alias("newlines"), F.sum("bytes").alias("bytes"))
    return counts.join(read, "role").select("role", "total_lines", "bad_lines", "not_utf8", "newlines", "bytes", "numbers", "turns")
