"""Nearest neighbours against brute force."""

import numpy as np

import pytest

from palimpsest.llm import ann
from palimpsest.llm.ann import Forest, Search, nearest


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) and len(v) == 8]
    out = {}
    for i, q in [(i, v) for i, v in good if i in queries]:
        d = sorted({(float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i})
        out[i] = d[:k]
    return out


def table(n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[n // 3 : n // 2] = x[0]
    return [(k, [float(a) for a in v]) for k, v in enumerate(x)]


def test_all_leaves_are_exact(spark):
    """A share of 1 visits every leaf."""
    rows = table(300) + [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0] * 7), (1004, [float("nan")] + [1.0] * 7), (1005, [float("inf")] + [1.0] * 7), (1006, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [rows[7], rows[7]]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    got = {}
    for r in nearest(df, df.where("vec_id % 10 = 0"), share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(rows, {k for k in range(0, 2000, 10)}, 10)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [i for _, i in got[k]] == [i for _, i in v]
        assert np.allclose([s for s, _ in got[k]], [s for s, _ in v], atol=1e-12)


def recall_of(got, x, step, k=10):
    hit = total = 0
    for q in range(0, len(x), step):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:k].tolist()))
        total += k
    return hit / total


@pytest.mark.parametrize("n", [40, 300, 900])
def test_small_tables_go_by_the_share_too(spark, n):
    """No table is searched otherwise because it is small, and enough is found."""
    x = np.random.default_rng(n).standard_normal((n, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 4 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(v) == 10 for v in got.values()) and recall_of(got, x, 4) >= 0.9


def test_the_forest_saves_distances(spark):
    """Distances computed fall with the share; clustered vectors need a small one for the same recall."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 5000)] + 0.15 * rng.standard_normal((5000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 50 = 0")
    search = lambda share: Search(df, asked, "vec_id", "embedding", 10, share, 0.94, None)
    some = [search(share) for share in (0.02, 0.1, 0.4)]
    done = [s.products() for s in some]
    assert done[0] < done[1] < done[2] and done[0] < 0.04 * 5000 * 100
    tuned = search(None)
    assert tuned.share < 0.25 and tuned.products() < 0.3 * 5000 * 100
    got = {}
    for r in tuned.run().collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall_of(got, x, 50) >= 0.9


@pytest.mark.parametrize("rows,queries", [(7, 3), (1000, 2), (5, 1000)])
def test_blocks_of_a_leaf(spark, monkeypatch, rows, queries):
    """Leaves of many rows and queries, in blocks, give what whole leaves give."""
    own = table(400)
    df = spark.createDataFrame([(k, v) for k, v in own], "vec_id long, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 8 = 0")
    whole = sorted(nearest(df, asked, share=0.3).collect())
    monkeypatch.setattr(ann, "ROWS", rows)
    monkeypatch.setattr(ann, "QUERIES", queries)
    assert sorted(nearest(df, asked, share=0.3).collect()) == whole


def test_share_is_measured(spark):
    rng = np.random.default_rng(5)
    loose, tight = Forest(rng.standard_normal((1500, 48))), Forest(rng.standard_normal((30, 48))[rng.integers(0, 30, 1500)] + 0.1 * rng.standard_normal((1500, 48)))
    assert tight.share_for(0.94, 10) < 0.2 < 0.5 < loose.share_for(0.94, 10) <= 1
    assert loose.share_for(0.5, 10) < loose.share_for(0.94, 10)
    one = Forest(rng.standard_normal((1, 4)))
    assert one.share_for(0.9, 10) == 1.0 and one.visit(np.ones(4), 1) == [0]


def test_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit / 600 >= 0.93


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 100, 0.0), (0, 2, 7, 1.0)]
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0
    f = Forest(np.random.default_rng(1).standard_normal((500, 4)), trees=3, leaf=32)
    assert all(len(np.unique(t.leaves(np.random.default_rng(2).standard_normal((400, 4))))) > 4 for t in f.trees)
