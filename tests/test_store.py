"""The table store: writers that meet, lists that can't be read, buckets that grow."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import store as store_module
from palimpsest.sources.store import Conflict, Store, leaf_of, split


def rows(spark, keys, text="t"):
    return spark.createDataFrame([(k, None, "m", text) for k in keys], "input_hash string, session_id string, model string, text string")


def read(store):
    return {r["input_hash"]: r["text"] for r in store.read("summaries").collect()}


def bucket(spark, store, key):
    return spark.createDataFrame([(key,)], "k string").select(leaf_of("k", list(store.current("summaries")["parts"]))).first()[0]


def between(store, monkeypatch, act):
    """Let another writer act between this one's read and its commit."""
    real = store._commit

    def commit(*a):
        monkeypatch.setattr(store, "_commit", real)
        act()
        return real(*a)

    monkeypatch.setattr(store, "_commit", commit)


def test_two_writers_of_other_keys(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.replace("summaries", rows(spark, ["p0"]))
    keys = [f"p{k}" for k in range(1, 60)]
    same = next(k for k in keys if bucket(spark, a, k) == bucket(spark, a, "pA"))
    other = next(k for k in keys if bucket(spark, a, k) != bucket(spark, a, "pA"))
    between(a, monkeypatch, lambda: b.replace("summaries", rows(spark, [other])))
    a.replace("summaries", rows(spark, ["pA"]))
    assert set(read(a)) == {"p0", "pA", other}
    # one bucket: done anew on top of the other writer's rows
    between(a, monkeypatch, lambda: b.replace("summaries", rows(spark, [same])))
    a.replace("summaries", rows(spark, ["pA"], "new"))
    assert read(a) == {"p0": "t", other: "t", same: "t", "pA": "new"}
    between(a, monkeypatch, lambda: b.remove("summaries", rows(spark, ["pA"])))
    a.remove("summaries", rows(spark, ["p0"]))
    assert set(read(a)) == {other, same}


def test_a_clash_is_refused_where_rows_depend_on_it(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.replace("summaries", rows(spark, ["x"]))
    base = a.version("summaries")
    b.replace("summaries", rows(spark, ["x"], "other"))
    with pytest.raises(Conflict):
        a.replace("summaries", rows(spark, ["x"], "mine"), base=base)
    base = a.version("summaries")
    between(a, monkeypatch, lambda: b.replace("summaries", rows(spark, ["x"], "later")))
    with pytest.raises(Conflict):
        a.replace("summaries", rows(spark, ["x"], "mine"), base=base)
    assert read(a) == {"x": "later"}
    between(a, monkeypatch, lambda: b.replace("summaries", rows(spark, ["y"])))
    with pytest.raises(Conflict):
        a.write("summaries", rows(spark, ["z"]))
    assert set(read(a)) == {"x", "y"}


def test_first_writers_meet(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    between(a, monkeypatch, lambda: b.replace("summaries", rows(spark, ["b"])))
    a.replace("summaries", rows(spark, ["a"]))
    assert set(read(a)) == {"a", "b"}


def test_appends_meet(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one = lambda k: spark.createDataFrame([(None, str(k), k, k)], a.read("metrics").schema)
    a.append("metrics", one(0))
    between(a, monkeypatch, lambda: b.append("metrics", one(1)))
    a.append("metrics", one(2))
    monkeypatch.setattr(store_module, "MOST_FOLDERS", 3)
    between(a, monkeypatch, lambda: b.append("metrics", one(3)))
    a.append("metrics", one(4))  # both write the folders anew
    assert sorted(r["items"] for r in a.read("metrics").collect()) == [0, 1, 2, 3, 4]


def test_a_list_made_meanwhile_is_not_lost(spark, tmp_path, monkeypatch):
    """Another writer has taken a number and writes its list while this one commits above it."""
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.replace("summaries", rows(spark, ["x"]))
    b.replace("summaries", rows(spark, ["y"]))
    whole = open(tmp_path / "summaries" / "v2.json").read()
    with open(tmp_path / "summaries" / "v2.json", "w") as f:
        f.write(whole[:20])
    os.remove(tmp_path / "summaries" / ".v2.json.crc")
    real = a._create

    def create(*args):
        done = real(*args)
        with open(tmp_path / "summaries" / "v2.json", "w") as f:
            f.write(whole)
        return done

    monkeypatch.setattr(a, "_create", create)
    key = next(k for k in "abcdefgh" if bucket(spark, a, k) not in (bucket(spark, a, "y"), bucket(spark, a, "x")))
    a.replace("summaries", rows(spark, [key]))
    assert set(read(a)) == {"x", "y", key}


def test_unreadable_lists_raise(spark, tmp_path):
    a = Store(spark, str(tmp_path))
    assert read(a) == {}
    a.replace("summaries", rows(spark, ["x"]))
    with open(tmp_path / "summaries" / "v1.json", "w") as f:
        f.write("{")
    os.remove(tmp_path / "summaries" / ".v1.json.crc")
    for act in (lambda: read(a), lambda: a.replace("summaries", rows(spark, ["y"])), lambda: a.write("summaries", rows(spark, ["y"]))):
        with pytest.raises(OSError):
            act()


def test_readers_keep_their_folders(spark, tmp_path, monkeypatch):
    a = Store(spark, str(tmp_path))
    a.replace("summaries", rows(spark, ["x"]))
    old = a.read("summaries")
    for k in range(3):
        a.replace("summaries", rows(spark, ["x"], str(k)))
    assert [r["text"] for r in old.collect()] == ["t"] and len(a._numbers("summaries")) == 4
    monkeypatch.setattr(store_module, "KEEP_MS", -1)
    a.replace("summaries", rows(spark, ["x"], "last"))
    assert a._numbers("summaries") == [5] and read(a) == {"x": "last"}
    assert len([x for x in os.listdir(tmp_path / "summaries") if x.startswith("part-")]) == 1


def test_buckets_split_alone(spark, tmp_path):
    a = Store(spark, str(tmp_path), most=500, depth=0)
    many = spark.range(9000).select(F.col("id").cast("string").alias("input_hash"), F.lit("s").alias("session_id"), F.lit("m").alias("model"), F.lit("t").alias("text"))
    a.replace("summaries", many.where("input_hash < '2'"))
    a.replace("summaries", many.where("input_hash >= '2'"))
    leaves = list(a.current("summaries")["parts"])
    held = {r["b"]: r["count"] for r in a.read("summaries").groupBy(leaf_of("input_hash", leaves).alias("b")).count().collect()}
    assert sum(held.values()) == 9000 and max(held.values()) <= 500 and len(leaves) < 64
    assert held == {x: n for x, n in a.current("summaries")["rows"].items() if n}
    before = a.current("summaries")["parts"]
    a.replace("summaries", rows(spark, ["17"], "new"))
    after = a.current("summaries")["parts"]
    assert sum(before[x] != after[x] for x in before) == 1 and a.read("summaries").where("text = 'new'").count() == 1
    # rows of one key stay together, however many; what shares their bucket is split off
    one = spark.range(3000).select(F.lit("hot").alias("input_hash"), F.lit("s").alias("session_id"), F.lit("m").alias("model"), F.col("id").cast("string").alias("text"))
    a.replace("summaries", one)
    held = sorted(a._counts("summaries", a.read("summaries"), list(a.current("summaries")["parts"])).values())
    assert held[-1] <= 3000 + 500 and held[-2] <= 500 and sum(held) == 12000
    a.remove("summaries", one.limit(1))
    assert a.read("summaries").count() == 9000


def test_split():
    sizes = {c: 10 for c in range(0, 64, 2)}  # of bucket 1.0, five bits more
    assert split("1.0", sizes, 1000, 5) == ["1.0"]
    for most in (10, 30, 100):
        parts = split("1.0", sizes, most, 5)
        held = [sum(n for x, n in sizes.items() if x & ((1 << int(p.split(".")[0])) - 1) == int(p.split(".")[1])) for p in parts]
        assert sum(held) == 320 and max(held) <= most
