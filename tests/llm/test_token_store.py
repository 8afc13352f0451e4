"""The token store against a plain encoding, by a round trip through its files."""

import zlib

import numpy as np

from palimpsest.llm.token_store import Shard, write_tokens
from palimpsest.llm.tokens import Encoder, default_path


def plain(rows):
    e, at, out = Encoder(default_path()), 0, []
    for key, text in rows:
        ids = e.whole(text or "") + (2).to_bytes(4, "little")
        out.append((key, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_round_trip(spark, tmp_path):
    rows = [(k, f"text number {k} " * (k % 37)) for k in range(400)] + [(1000, None), (1001, ""), (1002, "a b " * 40_000), (500, "same"), (500, "same")]
    docs = spark.createDataFrame([(t, k, 1) for k, t in rows], "text string, doc_id long, part int").repartition(5)
    store = write_tokens(docs, str(tmp_path / "a"))
    got = sorted(tuple(r) for r in store.read().collect())
    assert got == plain(sorted(rows, key=lambda r: r[0]))
    whole = {r["doc_id"]: r["ids"] for r in store.read(ids=True).collect()}
    assert np.array(whole[7], "<u4").tobytes()[:-4] == Encoder(default_path()).whole(dict(rows)[7])
    row = spark.read.parquet(str(tmp_path / "a" / "shards")).first()
    shard = Shard(bytes(row["blob"]), store.dictionary)
    assert len(shard.raw(0)) == 4 * shard.tokens[0]


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(None, "x"), (3, "y")], "doc_id long, text string")
    assert [tuple(r) for r in write_tokens(docs, str(tmp_path / "a")).read().orderBy("start").collect()] == plain([(None, "x"), (3, "y")])
    assert write_tokens(docs.limit(0), str(tmp_path / "b")).read().count() == 0


def test_hot_ids_spread_over_ranges(spark):
    """An id on many rows, and null ids, go to several ranges and stay in the order of id and hash."""
    from palimpsest.llm.token_store import range_of

    rng = np.random.default_rng(2)
    keys, hashes = np.sort(rng.choice([-5, 7, 7, 7, 9, 11], 4000)), rng.integers(-(1 << 63), 1 << 63, 4000)
    by = np.lexsort((hashes, keys))
    keys, hashes = keys[by], hashes[by]
    edges = np.array([keys[k * 500] for k in range(1, 8)])
    part = range_of(edges, keys, hashes)
    assert (np.diff(part) >= 0).all() and len(set(part[keys == 7])) >= 4 and np.bincount(part, minlength=8).max() < 1200
    assert range_of(np.zeros(0, np.int64), keys, hashes).max() == 0


def test_hot_ids_in_the_store(spark, tmp_path):
    import zlib

    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text {k % 50} of it") for k in range(900)]
    store = write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "t"))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in store.read().collect()), key=lambda r: r[0])
    e = Encoder(default_path())
    want = sorted((str(k), zlib.crc32(e.encode(t) + (2).to_bytes(4, "little"))) for k, t in rows)
    assert sorted((str(k), c) for _, k, _, c in got) == want
    assert [s for s, *_ in got] == np.concatenate([[0], np.cumsum([n for _, _, n, _ in got])[:-1]]).tolist()
    order = [(k is not None, k or 0) for _, k, _, _ in got]
    assert order == sorted(order)
