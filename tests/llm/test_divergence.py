"""Divergence of sources against exact fractions, and its SQL in DuckDB."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from palimpsest.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most=50):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, found in own for t in set(found))
        kept = [t for t, n in docs.items() if n >= least]
        v = len(kept)

        def p(group, kept=kept, v=v):
            n = Counter(t for r in group for t in r[2])
            whole = sum(n[t] for t in kept) + 5 * v
            return {t: (n[t], 1 + 10**9 * (n[t] + 5) // whole) for t in kept}

        sources = {s: p([r for r in own if r[1] == s]) for s in {r[1] for r in own}}
        q = p(own)
        for s, mine in sources.items():
            pairs = sorted(((-sum(abs(mine[t][1] - x[t][1]) for t in kept), o.encode()) for o, x in sources.items() if o != s))
            out += [(lang, s, "pair", o.decode(), -x, k) for k, (x, o) in enumerate(pairs, 1)]
            terms = sorted((q[t][1] - mine[t][1], t.encode()) for t in kept if mine[t][0] and mine[t][1] > q[t][1])
            out += [(lang, s, "term", t.decode(), -x, k) for k, (x, t) in enumerate(terms[:most], 1)]
    return sorted(out)


def corpus(sources=7, n=300, seed=3):
    rng = random.Random(seed)
    letters = ["a", "B", "é", "ÉÀ", "ß", "日本", "\U0001f600", "￿", "İ"]
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(120)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "de", None, ""])
        w = [rng.choice(vocabulary[: rng.choice([5, 30, 120])]) for _ in range(rng.randint(0, 40))]
        rows.append((lang, rng.choice([None, *(f"s{k}" for k in range(sources))]), rng.choice([" ", "1", "-", "[", "\x7f", "\n"]).join(w)))
    return rows + [("none", "x", "only here"), ("none", "y", None), ("none", "z", ""), ("en", "nothing", "12 34"), ("en", "s1", rows[0][2]), ("en", "s1", rows[0][2]), ("one", None, "a")]


@pytest.mark.parametrize("chunk,block,most", [(4096, 64, 50), (7, 2, 50), (1, 3, 4)])
def test_against_plain(spark, monkeypatch, chunk, block, most):
    monkeypatch.setattr(D, "CHUNK", chunk)
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "_HELD", 40)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, chunk string").repartition(4)
    out = D.divergence(docs, least=10, most=most)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    got = sorted(tuple(r) for r in out.collect())
    assert got == plain(rows, 10, most)
    assert {r[2] for r in got} == {"pair", "term"}


def test_sql(spark, tmp_path):
    rows = corpus(n=700)
    spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    mine = sorted(tuple(r) for r in D.op11_source_divergence(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert mine == sorted(db.execute(D.SQL).fetchall()) == plain(rows, 30)


def test_shares_are_exact():
    """Also where SCALE times the count is beyond 64 bits."""
    rng = random.Random(1)
    for top in (10, 10**6, 10**12, 8 * 10**15):
        whole = [rng.randint(1, top) + 5 for _ in range(300)]
        counts = [rng.randint(0, w - 5) for w in whole]
        got = D.shares(np.array(counts), np.array(whole)).tolist()
        assert got == [1 + 10**9 * (c + 5) // w for c, w in zip(counts, whole, strict=True)]


def test_empty_and_long(spark):
    schema = "lang string, source string, text string"
    assert D.divergence(spark.createDataFrame([], schema)).count() == 0
    rows = [("en", "a", "word " * 400_000), ("en", "b", "word " + "other " * 300_000)]
    assert sorted(tuple(r) for r in D.divergence(spark.createDataFrame(rows, schema), least=1).collect()) == plain(rows, 1)
