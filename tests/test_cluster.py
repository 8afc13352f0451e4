"""Density clusters over pairs of blocks: results of many sides, and what travels."""

import numpy as np
import pytest

from palimpsest.operators import cluster


def points(n, groups=1, seed=3):
    """Some tight clusters of chunks, chains and noise."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, 16))
    v = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, 16))
    return [(k, f"p{k % groups}", [float(x) for x in row]) for k, row in enumerate(v)]


def plain(rows, eps, least=4):
    out = {}
    for project in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == project]
        ids, v = np.array([r[0] for r in own]), np.array([r[2] for r in own])
        v /= np.linalg.norm(v, axis=1)[:, None]
        near = (1 - v @ v.T <= eps) & ~np.eye(len(v), dtype=bool)
        core = near.sum(1) + 1 >= least
        name = {}
        for k in np.argsort(ids):
            todo = [k] if core[k] and k not in name else []
            while todo:
                x = todo.pop()
                if x not in name:
                    name[x] = ids[k]
                    todo += np.flatnonzero(near[x] & core).tolist()
        for k in range(len(ids)):
            names = [name[k]] if k in name else [name[x] for x in np.flatnonzero(near[k] & core)]
            if names:
                out[int(ids[k])] = (project, int(min(names)))
    return out


def found(spark, rows, eps):
    df = spark.createDataFrame(rows, "chunk_id long, project_id string, embedding array<double>")
    return {r.chunk_id: (r.project_id, r.cluster) for r in cluster.dbscan(df, eps).collect()}


@pytest.mark.parametrize("held, edges", [(256, 1 << 20), (2, 16)])
def test_dbscan_over_many_sides(spark, monkeypatch, held, edges):
    for name, value in (("BLOCK", 16), ("SIDES", 3), ("HELD", held), ("_EDGES", edges)):
        monkeypatch.setattr(cluster, name, value)
    rows = points(300, groups=2)
    expected = plain(rows, 0.12)
    assert len({c for _, c in expected.values()}) > 10 and len(expected) < len(rows)
    assert found(spark, rows, 0.12) == expected


def test_each_pair_of_blocks_once(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("SIDES", 3), ("HELD", 8)):
        monkeypatch.setattr(cluster, name, value)
    rows = spark.range(150).selectExpr("id as i", "'p' as g")
    pairs = cluster.block_pairs(rows, "g").selectExpr("least(x, y) as a", "greatest(x, y) as b", "same").collect()
    blocks = {p.a for p in pairs if p.same}
    assert sorted((p.a, p.b) for p in pairs) == sorted((a, b) for a in blocks for b in blocks if a <= b)


def shuffled(spark, work):
    """Bytes that work's stages wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (own.apply(k) for own in [sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for k in range(own.size()))}
    before = stages()
    work()
    sc.listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_shuffle_grows_as_the_rows_do(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 8)
    monkeypatch.setattr(cluster, "SIDES", 4, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, two = (shuffled(spark, lambda n=n: found(spark, points(n), 0.12)) for n in (400, 1600))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert two < 4 * 1.3 * one
