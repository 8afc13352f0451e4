"""Topics: density clusters of vectors by project, their centroids, and edges between them.

Vectors meet in pairs of blocks, each pair a row of its own. The blocks of a project are dealt to a fixed number of sides, and a block
travels once to each pair of sides, where it meets all blocks of the other: all pairs are compared, but what is shuffled grows as the
rows do. Equal vectors are one class before, and what a task gives is bounded by its rows, not its pairs: sums, links of a
spanning forest, best ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.operators.components import components
from palimpsest.plans.materialize import stash

EPS, SMALL_EPS, SMALL, LEAST = 0.18, 0.12, 25, 4
BLOCK = 1024
#: A group's blocks are dealt to this many sides; a block travels once to each pair of sides, whatever the group's size.
SIDES = 12
#: Blocks that a side may hold, as a task keeps one side in memory, about 150 MB: groups of over SIDES times as many (3 million rows) have more sides.
HELD = 256
_EDGES = 1 << 20  # links that a task gathers before it keeps a spanning forest of them


def in_blocks(rows: DataFrame, group: str, name: str) -> DataFrame:
    """group, _b, _n and an array `name` of the other columns of rows (i, v and more): blocks of about BLOCK rows, their number from 0 and how many the
    group has."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    spread = rows.join(sizes, group).withColumn("_b", F.pmod(F.xxhash64("i"), F.col("_n")))
    own = [F.col(c) for c in rows.columns if c != group]
    return spread.groupBy(group, "_n", "_b").agg(F.collect_list(F.struct(*own)).alias(name))


def _sides(blocks: DataFrame) -> DataFrame:
    """blocks and _s: how many sides its group's blocks are dealt to; _side: the block's own."""
    n = F.greatest(F.least("_n", F.lit(SIDES)), F.ceil(F.col("_n") / HELD)).cast("long")
    return blocks.withColumn("_s", n).withColumn("_side", F.pmod(F.col("_b").cast("long"), "_s"))


def block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """group, x and y (numbers of blocks), same (boolean), xs and ys: each pair of blocks of a group once, and each block with itself."""
    packed = stash(_sides(in_blocks(rows, group, "rows")), "blocks")
    own, first = F.col("_side"), F.lit(0).cast("long")
    one = packed.select(group, own.alias("p"), F.explode(F.sequence(own, F.col("_s") - 1)).alias("q"), F.col("_b").alias("x"), F.col("rows").alias("xs"))
    two = packed.select(group, F.explode(F.sequence(first, own)).alias("p"), own.alias("q"), F.col("_b").alias("y"), F.col("rows").alias("ys"))
    pairs = one.join(two, [group, "p", "q"]).where((F.col("p") < F.col("q")) | (F.col("x") <= F.col("y")))
    return pairs.select(group, "x", "y", (F.col("x") == F.col("y")).alias("same"), "xs", "ys")


def cross_blocks(rows: DataFrame, others: DataFrame, group: str) -> DataFrame:
    """group, xs and ys: each block of rows with each block of others of its group."""
    xs, ys = (stash(_sides(in_blocks(df, group, name)), "blocks") for df, name in ((rows, "xs"), (others, "ys")))
    counts = lambda df: df.select(group, (F.col("_s") - 1).alias("_last")).distinct()
    every, own = F.explode(F.sequence(F.lit(0).cast("long"), "_last")), F.col("_side")
    one = xs.join(counts(ys), group).select(group, own.alias("p"), every.alias("q"), "xs")
    two = ys.join(counts(xs), group).select(group, every.alias("p"), own.alias("q"), "ys")
    return one.join(two, [group, "p", "q"]).select(group, "xs", "ys")


def _side(column, k: int) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Ids, vectors (rows) and all fields of the k-th block."""
    own = column[k].values
    i = np.array(own.field("i").to_pylist(), dtype=object if pa.types.is_string(own.type.field("i").type) else None)
    return i, own.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1), own


def _near(batch: pa.RecordBatch, k: int):
    """xs, ys and which of them are within eps of each other, none of itself."""
    xs, ys = _side(batch.column("xs"), k), _side(batch.column("ys"), k)
    near = 1 - xs[1] @ ys[1].T <= xs[2].field("eps")[0].as_py()
    if "same" in batch.schema.names and batch.column("same")[k].as_py():
        near &= xs[0][:, None] != ys[0][None]
    return xs, ys, near


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def neighbours(vectors: DataFrame, eps: DataFrame | float, id_col: str = "chunk_id") -> DataFrame:
    """(project_id, a, b) of pairs of a project, a < b, whose cosine distance is at most eps (a number, or by project_id): all links, for
    callers that want them as rows. Clusters and edges do without."""
    rows = _rows(vectors, eps, id_col)
    schema = pa.schema([("project_id", _arrow(vectors, "project_id")), ("a", _arrow(vectors, id_col)), ("b", _arrow(vectors, id_col))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (i, _, _), (j, _, _), near = _near(batch, k)
                p, q = np.nonzero(near)
                if batch.column("same")[k].as_py():
                    p, q = p[i[p] < j[q]], q[i[p] < j[q]]
                if len(p):
                    low = i[p] < j[q]
                    yield _batch(schema, [batch.column("project_id")[k].as_py()] * len(p), np.where(low, i[p], j[q]).tolist(), np.where(low, j[q], i[p]).tolist())

    return block_pairs(rows, "project_id").mapInArrow(run, _spark(vectors, "project_id", id_col, "a", "b")).distinct()


def _rows(vectors: DataFrame, eps: DataFrame | float, id_col: str, *more: str) -> DataFrame:
    """project_id, i, v (normalised), eps and more columns."""
    vectors = vectors.join(eps, "project_id") if isinstance(eps, DataFrame) else vectors.withColumn("eps", F.lit(float(eps)))
    return vectors.select("project_id", F.col(id_col).alias("i"), vx.normalise(F.col("embedding")).alias("v"), F.col("eps").cast("double").alias("eps"), *more)


def _arrow(df: DataFrame, c: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[c].dataType)


def _spark(df: DataFrame, group: str, id_col: str, *names: str) -> str:
    kind = df.schema[id_col].dataType.simpleString()
    return ", ".join([f"{group} {df.schema[group].dataType.simpleString()}", *(f"{n} {kind}" for n in names)])


def nearest_of_group(rows: DataFrame, others: DataFrame, group: str, id_col: str = "id") -> DataFrame:
    """(id_col, nearest, score): for each of rows (group, id_col, embedding) the most similar of others of its group with
    another id, ties to the largest. Blocks meet blocks; a pair of them keeps one best for each row."""
    schema = pa.schema([(id_col, _arrow(rows, id_col)), ("nearest", _arrow(rows, id_col)), ("score", pa.float64())])
    shaped = lambda df: df.select(group, F.col(id_col).alias("i"), vx.normalise(F.col("embedding")).alias("v"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (i, a, _), (j, b, _) = _side(batch.column("xs"), k), _side(batch.column("ys"), k)
                by = np.argsort(j)[::-1]  # of equal scores the first is the largest id
                j, b = j[by], b[by]
                score = np.where(i[:, None] == j[None], -np.inf, a @ b.T)
                best = score.argmax(1)
                top = score[np.arange(len(i)), best]
                good = top > -np.inf
                if good.any():
                    yield _batch(schema, i[good].tolist(), j[best[good]].tolist(), top[good].tolist())

    kind = rows.schema[id_col].dataType.simpleString()
    pairs = cross_blocks(shaped(rows), shaped(others), group).mapInArrow(run, f"{id_col} {kind}, nearest {kind}, score double")
    return pairs.groupBy(id_col).agg(F.max(F.struct("score", "nearest")).alias("m")).select(id_col, F.col("m.nearest").alias("nearest"), F.col("m.score").alias("score"))


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes, numbered from 0, the first node of its component under the links p-q."""
    label = np.arange(n)
    while True:
        a, b, new = label[p], label[q], label.copy()
        np.minimum.at(new, np.maximum(a, b), np.minimum(a, b))
        while (new != new[new]).any():  # chains halve
            new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as a-b do: the first node of each component with each other one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(nodes), at[: len(a)], at[len(a) :])
    own = root != np.arange(len(nodes))
    return nodes[root[own]], nodes[own]


def dbscan(vectors: DataFrame, eps: float | None = None, least: int = LEAST, id_col: str = "chunk_id") -> DataFrame:
    """(project_id, id_col, cluster): clusters are named by their smallest core point; noise isn't returned. A cluster is a
    component of core points within eps; a border point goes to the one of its clusters with the smallest name.
    Without eps, projects of under SMALL vectors use SMALL_EPS, others EPS.

    Three passes over pairs of blocks: how many each vector is near to, links between core points, clusters of the others. Every pair is
    compared in the first, so that CPU time grows as the square of a project's distinct vectors; what is shuffled does not."""
    by_project = eps if eps is not None else vectors.groupBy("project_id").agg(F.when(F.count("*") < SMALL, SMALL_EPS).otherwise(EPS).alias("eps"))
    base = stash(_rows(vectors, by_project, id_col), "normalised")
    # equal vectors are one class, by its smallest id; zero vectors are near to nothing
    weight = F.when(F.exists("v", lambda x: x != 0), F.col("k")).otherwise(F.lit(1)).cast("long")
    classes = base.groupBy("project_id", "v").agg(F.min("i").alias("i"), F.max("eps").alias("eps"), F.count("*").alias("k"))
    reps = stash(classes.select("project_id", "i", "v", "eps", weight.alias("w")), "classes")
    members = base.select("project_id", "v", F.col("i").alias(id_col)).join(reps.select("project_id", "v", F.col("i").alias("rep")), ["project_id", "v"])
    kind, project = _arrow(vectors, id_col), _arrow(vectors, "project_id")
    counted = pa.schema([("project_id", project), ("i", kind), ("n", pa.int64())])
    linked = pa.schema([("a", kind), ("b", kind)])
    named_as = pa.schema([("project_id", project), ("i", kind), ("cluster", kind)])

    def degrees(batches):
        """Sums over a task's pairs, up to so many rows as a pair of sides has."""
        held, size = {}, 0
        for batch in batches:
            for k in range(batch.num_rows):
                (i, _, xs), (j, _, ys), near = _near(batch, k)
                p, x, y, same = (batch.column(c)[k].as_py() for c in ("project_id", "x", "y", "same"))
                found = [(x, i, near @ ys.field("w").to_numpy())]
                if not same:
                    found.append((y, j, near.T @ xs.field("w").to_numpy()))
                for block, own, n in found:
                    if (p, block) in held:
                        held[p, block][1] += n
                    else:
                        held[p, block] = [own, n]
                        size += len(own)
                if size >= 2 * HELD * BLOCK:
                    yield from (_batch(counted, [p] * len(own), own.tolist(), n.tolist()) for (p, _), (own, n) in held.items())
                    held, size = {}, 0
        yield from (_batch(counted, [p] * len(own), own.tolist(), n.tolist()) for (p, _), (own, n) in held.items())

    def links(batches):
        """A spanning forest of the links of a task's pairs, or of those of about a pair of sides."""
        more, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                (i, _, _), (j, _, _), near = _near(batch, k)
                same = batch.column("same")[k].as_py()
                nodes = i if same else np.concatenate([i, j])
                p, q = np.nonzero(near)
                root = roots(len(nodes), p, q if same else len(i) + q)
                own = np.flatnonzero(root != np.arange(len(nodes)))
                if len(own):
                    more.append((nodes[root[own]], nodes[own]))
                    size += len(own)
                if size >= _EDGES:
                    a, b = forest(*(np.concatenate(x) for x in zip(*more, strict=True)))
                    if len(a) >= _EDGES // 2:
                        yield _batch(linked, a.tolist(), b.tolist())
                        more, size = [], 0
                    else:
                        more, size = [(a, b)], len(a)
        if more:
            a, b = forest(*(np.concatenate(x) for x in zip(*more, strict=True)))
            yield _batch(linked, a.tolist(), b.tolist())

    def borders(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (i, _, _), (_, _, ys), near = _near(batch, k)
                theirs = ys.field("cluster").to_pylist()
                names = sorted(set(theirs))
                rank = {x: n for n, x in enumerate(names)}
                best = np.where(near, np.array([rank[x] for x in theirs])[None], len(names)).min(1)
                hit = np.flatnonzero(best < len(names))
                if len(hit):
                    yield _batch(named_as, [batch.column("project_id")[k].as_py()] * len(hit), i[hit].tolist(), [names[n] for n in best[hit]])

    kinds = vectors.schema[id_col].dataType.simpleString(), vectors.schema["project_id"].dataType.simpleString()
    near = block_pairs(reps, "project_id").mapInArrow(degrees, f"project_id {kinds[1]}, i {kinds[0]}, n long").groupBy("project_id", "i").agg(F.sum("n").alias("n"))
    core = stash(reps.join(near, ["project_id", "i"]).where(F.col("n") + F.col("w") >= least).select("project_id", "i", "v", "eps"), "core")
    tied = block_pairs(core, "project_id").mapInArrow(links, f"a {kinds[0]}, b {kinds[0]}")
    found = components(tied.union(core.select(F.col("i").alias("a"), F.col("i").alias("b")))).df
    named = stash(core.join(found, core.i == found.node).select("project_id", "i", F.col("comp").alias("cluster")), "named")
    rest = reps.drop("w").join(named.select("project_id", "i"), ["project_id", "i"], "left_anti")
    around = cross_blocks(rest, core.join(named, ["project_id", "i"]), "project_id")
    border = around.mapInArrow(borders, f"project_id {kinds[1]}, i {kinds[0]}, cluster {kinds[0]}").groupBy("project_id", "i").agg(F.min("cluster").alias("cluster"))
    every = named.unionByName(border).withColumnRenamed("i", "rep")
    return members.select("project_id", "rep", id_col).join(every, ["project_id", "rep"]).select("project_id", id_col, "cluster")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """group and centroid: the normalised mean of each group's vectors, in components."""
    parts = vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return parts.groupBy(group).agg(mean.alias("mean")).select(group, vx.normalise(F.col("mean")).alias("centroid"))


def central(vectors: DataFrame, group: str, centres: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The member nearest to its group's centroid; ties to the smallest id."""
    scored = vectors.join(centres, group).select(group, id_col, vx.dot(F.col("embedding"), F.col("centroid")).alias("score"))
    return scored.groupBy(group).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"))).alias("m")).select(group, F.col("m.i").alias(id_col), (-F.col("m.s")).alias("score"))


def topics(vectors: DataFrame, clusters: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """A topic for each cluster: id, label and description of the most central member, members, sessions, centroid, size."""
    own = vectors.join(clusters.select(id_col, "cluster"), id_col)
    centres = stash(centroids(own, "cluster"), "centroids")
    best = central(own, "cluster", centres, id_col).join(chunks.select(id_col, tx.one_line("text").alias("line")), id_col)
    best = best.select("cluster", tx.first_sentence("line").alias("label"), tx.clip("line", 240).alias("description"))
    members = own.groupBy("cluster").agg(F.array_sort(F.collect_set(F.col(id_col).cast("string"))).alias("members"), F.array_sort(F.collect_set("session_id")).alias("sessions"), F.array_sort(F.collect_set("project_id")).alias("projects"))
    out = members.join(centres, "cluster").join(best, "cluster", "left")
    return out.select(ids.topic_id(F.col("members")).alias("topic_id"), "label", "description", "members", "sessions", "projects", "centroid", F.size("members").alias("size"))


def naming_prompts(topics: DataFrame, chunks: DataFrame, samples: int = 3, most: int = 600) -> DataFrame:
    """(topic_id, prompt): a topic's description, the start of up to `samples` more of its members and how many there are, for a model
    to name it."""
    others = topics.select("topic_id", F.posexplode(F.slice("members", 2, samples)).alias("n", "chunk_id"))
    shown = others.join(chunks.select("chunk_id", tx.clip("text", most).alias("text")), "chunk_id")
    shown = shown.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.concat(F.lit("Sample chunk:\n"), x["text"], F.lit("\n\n"))), "").alias("shown"))
    counts = F.format_string("There are %d chunks in this topic across %d session(s).", F.col("size"), F.size("sessions"))
    return topics.join(shown, "topic_id", "left").select("topic_id", F.concat(F.lit("Centroid chunk:\n"), F.coalesce("description", F.lit("")), F.lit("\n\n"), F.coalesce("shown", F.lit("")), counts).alias("prompt"))


def similarity_edges(topics: DataFrame, threshold: float = 0.78, k: int = 5, id_col: str = "topic_id") -> DataFrame:
    """Edges between topics whose centroids' cosine reaches the threshold and that are among the k nearest of either. A pair of blocks
    gives the k nearest of each of its rows."""
    n = topics.select(F.lit(0).alias("project_id"), F.col(id_col), F.col("centroid").alias("embedding"))
    schema = pa.schema([("from", _arrow(topics, id_col)), ("to", _arrow(topics, id_col))])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                xs, ys, near = _near(batch, r)
                for (i, a, _), (j, b, _), ok in ((xs, ys, near), (ys, xs, near.T))[: 1 if batch.column("same")[r].as_py() else 2]:
                    by = np.argsort(j)  # of equal ones the smallest ids come first
                    score = np.where(ok[:, by], a @ b[by].T, -np.inf)
                    # some more than k, as the exact order is found outside
                    top = np.argsort(-score, axis=1, kind="stable")[:, : k + 3]
                    p, q = np.nonzero(np.take_along_axis(score, top, 1) > -np.inf)
                    if len(p):
                        yield _batch(schema, i[p].tolist(), j[by][top[p, q]].tolist())

    kind = topics.schema[id_col].dataType.simpleString()
    near = block_pairs(_rows(n, 1 - threshold + 1e-9, id_col), "project_id").mapInArrow(run, f"from {kind}, to {kind}").distinct()
    own = topics.select(F.col(id_col), vx.normalise(F.col("centroid")).alias("c"))
    pairs = near.join(own.select(F.col(id_col).alias("from"), F.col("c").alias("ca")), "from").join(own.select(F.col(id_col).alias("to"), F.col("c").alias("cb")), "to")
    low, high = F.least("from", "to"), F.greatest("from", "to")
    first = F.when(F.col("from") < F.col("to"), F.col("ca")).otherwise(F.col("cb"))
    second = F.when(F.col("from") < F.col("to"), F.col("cb")).otherwise(F.col("ca"))
    pairs = pairs.select("from", "to", low.alias("a"), high.alias("b"), vx.dot(first, second).alias("cosine")).where(F.col("cosine") >= threshold)
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("from").orderBy(F.desc("cosine"), "to"))).where(F.col("r") <= k)
    out = ranked.select("a", "b", "cosine").distinct()
    weight = F.least(F.greatest((F.col("cosine") - threshold) / (1 - threshold), F.lit(0.0)), F.lit(1.0))
    return out.select(ids.edge_id(F.lit("topic-similarity"), F.col("a").cast("string"), F.col("b").cast("string")).alias("edge_id"), "a", "b", "cosine", weight.alias("weight"), F.format_string("cosine=%.3f", F.col("cosine")).alias("evidence"))


def shared_file_edges(paths: DataFrame, least: int = 3) -> DataFrame:
    """Edges between topics that both refer at least `least` times to a path; paths (topic_id, path), a row a reference. Each such pair
    is a row of the result; those of a path that many topics share are found in pairs of blocks, over many tasks."""
    counts = stash(paths.groupBy("topic_id", "path").agg(F.count("*").alias("n")).where(F.col("n") >= least), "path-counts")
    sizes = counts.groupBy("path").agg(F.ceil(F.count("*") / BLOCK).alias("_n")).where("_n > 0")
    spread = counts.join(sizes, "path").withColumn("_b", F.pmod(F.xxhash64("topic_id"), F.col("_n")))
    one = spread.select("path", F.col("topic_id").alias("one"), F.col("_b").alias("x"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("y"))
    two = spread.select("path", F.col("topic_id").alias("two"), F.explode(F.sequence(F.lit(0).cast("long"), "_b")).alias("x"), F.col("_b").alias("y"))
    both = one.join(two, ["path", "x", "y"]).where((F.col("x") < F.col("y")) & (F.col("one") != F.col("two")) | (F.col("one") < F.col("two")))
    pairs = both.select("path", F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("path")), 1, 5).alias("evidence"))
    return pairs.select(ids.edge_id(F.lit("shared-file"), F.col("a").cast("string"), F.col("b").cast("string")).alias("edge_id"), "a", "b", F.col("n").alias("shared"), F.least(F.col("n") / 5, F.lit(1.0)).alias("weight"), "evidence")


def report(vectors: DataFrame, clusters: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Topics, clustered and other chunks by project, and over all (project_id null)."""
    rows = vectors.select("project_id", id_col).join(clusters.select(id_col, "cluster"), id_col, "left")
    return rows.rollup("project_id").agg(F.countDistinct("cluster").alias("topics"), F.count("cluster").alias("clustered"), F.count_if(F.col("cluster").isNull()).alias("ungrouped"))
