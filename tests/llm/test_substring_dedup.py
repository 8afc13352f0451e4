"""Dedup by difference-cover anchors against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from palimpsest.llm import substring_dedup as S
from palimpsest.llm import words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width):
    split = [WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - width + 1) if k is not None else ():
            x = tuple(w[i : i + width])
            first[x] = min(first.get(x, k), k)
    out = []
    for (k, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1) if k is not None else ():
            if first[tuple(w[i : i + width])] < k:
                gone[i : i + width] = [True] * width
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus(width, n=80, seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "b", "é", " ", "cd", "x" * 40]) + rng.choice("abcdefghij")
    run = lambda k: "".join(word() + rng.choice([" ", " ", "\n", " \t ", "\x0b"]) for _ in range(k))
    passages = [run(rng.randint(max(width - 5, 1), 3 * width)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(run(rng.randint(0, width)))
            if rng.random() < 0.6:
                own = rng.choice(passages).split(" ")
                a = rng.randrange(len(own) // 2 + 1)
                parts.append(" ".join(own[a:]))
        rows.append((k * 7 % 1009, " ".join(parts)))
    whole = rows[3][1]
    one = rows[5][1].split()
    one[len(one) // 2] = "changed"
    rows += [(2000, "a " * (4 * width)), (2001, "a " * (2 * width)), (1999, "a b " * width), (2003, None), (2004, ""), (2005, whole), (-5, whole), (2006, " \n"), (2007, "q " * (width - 1)), (2008, "q " * width), (None, whole), (None, whole), (2009, " ".join(one))]
    return rows


@pytest.mark.parametrize("width", [50, 12, 80, 4])
def test_against_all_windows(spark, width):
    rows = corpus(width)
    docs = spark.createDataFrame([(t, k, 1, "s") for k, t in rows], "text string, doc_id long, q long, _a string").repartition(5)
    out = S.substring_dedup(docs, width=width)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=str) == plain(rows, width)
    digests = {(r["kept"], r["kept_sha256"]) for r in out.collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == d for t, d in digests)


def test_joins_by_shuffle(spark, monkeypatch):
    """What is too much to broadcast gives the same rows."""
    monkeypatch.setattr(S, "_BROADCAST", 3)
    rows = corpus(50, seed=8)
    out = S.substring_dedup(spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=str) == plain(rows, 50)


def test_repeated_ids(spark):
    """Rows of one id take nothing from each other; each is returned."""
    rng = random.Random(2)
    a, b = (" ".join(rng.choice("abcdefghi") * rng.randint(1, 4) for _ in range(90)) for _ in range(2))
    rows = [(5, a), (5, a), (5, b + " " + a), (7, a), (7, a), (7, "x " + b), (6, "short")]
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), text=False)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == [(5, 90, 0), (5, 90, 0), (5, 180, 0), (6, 1, 0), (7, 90, 90), (7, 90, 90), (7, 91, 90)]


def test_many_copies(spark):
    """Thousands of copies and of rows of one id are a few classes."""
    rng = random.Random(4)
    passage = " ".join("".join(rng.choices("abcde", k=5)) for _ in range(300))
    rows = [(k, passage) for k in range(3000)] + [(9000, "w " + passage)] * 2000
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), text=False)
    assert got.groupBy("n_words", "n_removed").count().orderBy("n_words", "n_removed").collect() == [(300, 0, 1), (300, 300, 2999), (301, 300, 2000)]


def test_very_long_texts(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n))
    p, q = text(70), text(50)
    rows = [(1, text(200_000) + " " + p + " " + text(150_000) + " " + q), (2, text(30) + " " + p), (3, text(180_000) + " " + q + " end")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), text=False).collect()}
    assert got == {1: (350_120, 0), 2: (100, 70), 3: (180_051, 50)}


def test_blocks_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(5000)).encode()
    whole = S.anchors([b"first one", text, b"", b"last"], 50)
    order = lambda x: np.lexsort((x[1], x[0]))
    for block, n in ((1 << 20, 700), (3000, 700), (3000, 61)):
        monkeypatch.setattr(words, "BLOCK", block)
        monkeypatch.setattr(S, "_WORDS", n)
        parts = S.anchors([b"first one", text, b"", b"last"], 50)
        assert all((a[order(whole)] == b[order(parts)]).all() for a, b in zip(whole, parts, strict=True)), (block, n)


def test_covers():
    """Every distance modulo the period is one between two positions of the cover."""
    for p, own in S.COVERS.items():
        assert {(a - b) % p for a in own for b in own} == set(range(p))
    assert [S.period(w) for w in (4, 12, 50, 100)] == [3, 7, 31, 57]
    with pytest.raises(ValueError):
        S.period(3)


def test_empty_table(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    """The query on a given table, against all windows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {k: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for k, n, gone, t in plain([tuple(r) for r in docs.select("doc_id", "text").collect()], 50)}
    got = {r[0]: tuple(r)[1:] for r in S.op13_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(x[1] for x in want.values())
