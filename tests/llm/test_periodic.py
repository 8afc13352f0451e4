"""Runs against all periods, and the query against a plain reading of its contract."""

import hashlib
import random
import re
import zlib

import pytest

from palimpsest.llm import words
from palimpsest.llm.periodic import op12_periodic_runs, periodic_runs, text_runs
from palimpsest.llm.runs import factorise, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w, least):
    """Every stretch that keeps a period, for all periods, smallest first."""
    out, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] == w[i + p]:
                j = i
                while j + p < n and w[j] == w[j + p]:
                    j += 1
                if j + p - i >= max(2 * p, least):
                    out.setdefault((i, j + p), p)
                i = j
            i += 1
    return sorted((a, b - a, p) for (a, b), p in out.items())


def sequences(seed, count=400):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 4, 8])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 6)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.3:
                w += w[: rng.randint(0, n)]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = 9
        yield w


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    for w in sequences(seed):
        for least in (2, 5, 12):
            assert runs(w, least) == plain(w, least), (w, least)


def test_structured_sequences():
    fibonacci, thue = [0], [0]
    other = [1]
    for _ in range(14):
        fibonacci, other = fibonacci + other, fibonacci
    for _ in range(9):
        thue += [1 - x for x in thue]
    for w in (fibonacci, thue, [0] * 500, [0, 1] * 200 + [2] + [1, 0] * 200, list(range(300)) * 2, list(range(100))):
        assert runs(w, 2) == plain(w, 2)
        assert runs(w, 12) == plain(w, 12)


def test_factors():
    """Each factor is the longest string that begins earlier too, or a new letter."""
    for w in sequences(99, 100):
        at = 0
        for first, end, earlier in factorise(w):
            assert first == at
            longest = max((k for s in range(at) for k in range(1, len(w) - at + 1) if w[s : s + k] == w[at : at + k]), default=0)
            assert end - first == max(longest, 1)
            assert (earlier < 0) == (longest == 0) and (earlier < 0 or earlier < at and w[earlier : earlier + end - at] == w[at:end])
            at = end
        assert at == len(w)


def test_text_runs(monkeypatch):
    """Stretches between windows that occur once hold all runs, in whatever blocks texts are hashed."""
    texts = [" ".join("abcdefghij"[x] for x in w).encode() for w in sequences(7, 120)] + [b"", b" \n", "é é x ".encode() * 9]
    want = []
    for t in texts:
        w = WORDS.findall(t.decode())
        want.append(plain(w, 12))
    assert text_runs(texts, 12) == want
    monkeypatch.setattr(words, "BLOCK", 200)
    assert text_runs(texts, 12) == want


def test_operator(spark):
    rng = random.Random(3)
    own = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = [(1, own), (None, "a b  c\td " * 5), (3, None), (4, ""), (5, "x\n" * 11), (5, "x\n" * 12), (5, "x\n" * 12), (7, own + " z" * 13 + " " + own), (8, " \x0b ")]
    docs = spark.createDataFrame([(k, t, "mine", "row") for k, t in rows], "doc_id long, text string, runs string, _row string")
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "_row", "runs", "collapsed"]
    got = {(r["doc_id"], r["text"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, own] == ([], own) and got[3, None] == ([], "") and got[4, ""] == ([], "") and got[8, " \x0b "] == ([], "")
    assert got[None, rows[1][1]] == ([(0, 20, 4)], "a b c d")
    assert got[5, "x\n" * 11] == ([], " ".join("x" * 11)) and got[5, "x\n" * 12] == ([(0, 12, 1)], "x")
    assert got[7, rows[7][1]] == ([(200, 13, 1)], own + " z " + own)
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, least=3)


def test_very_long_text(spark):
    rng = random.Random(5)
    tail = " ".join(f"t{rng.randrange(900)}" for _ in range(700))
    head = " ".join(f"h{k}" for k in range(250_000))
    got = periodic_runs(spark.createDataFrame([(1, head + " " + " ".join([tail] * 3))], "doc_id long, text string")).first()
    assert [tuple(x) for x in got["runs"]] == [(250_000, 2100, 700)] and got["collapsed"] == head + " " + tail


def contract(k, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(k).encode()) if k is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain(w, 12)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (k, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 90)))) for k in range(400)]
    rows += [(None, "a " * 30), (1001, None), (1002, ""), (-7, "b c\n" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((contract(k, t) for k, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 6000").select("doc_id", "text").collect()
    got = {r[0]: tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert all(got[k] == contract(k, t) for k, t in docs)
