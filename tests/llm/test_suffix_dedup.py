"""Suffix dedup against a dictionary of all windows, and its pieces against plain suffix sorting."""

import hashlib
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import suffix_dedup as S
from palimpsest.llm.factors import factors


def corpus(n=70, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 9)))
    passages = ["".join(word() for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append("".join(word() for _ in range(rng.randint(0, 150))))
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p) // 2)
                parts.append(p[a : a + rng.randint(300, len(p))])
        rows.append((k * 7 % 1009, "".join(parts)))
    rows += [(2000, "a" * 1500), (2001, "ab" * 500), (2002, "xyz" * 300), (2003, None), (2004, ""), (2005, rows[3][1]), (2006, rows[3][1]), (2007, "q" * 399), (2008, "q" * 400)]
    return rows


def plain(rows, least, keep):
    texts = sorted(((k, (t or "").encode()) for k, t in rows), key=lambda r: r[0])
    places = {}
    for d, (_, t) in enumerate(texts):
        for p in range(len(t) - least + 1):
            places.setdefault(t[p : p + least], []).append((d, p))
    mask = [np.zeros(len(t), bool) for _, t in texts]
    for w in places.values():
        for d, p in w if keep == "none" and len(w) > 1 else w[1:]:
            mask[d][p : p + least] = True
    out = {}
    for (k, t), m in zip(texts, mask, strict=True):
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        out[k] = (len(t), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("keep,gather", [("none", 3000), ("first", 3000), ("none", 1), ("first", 1), ("none", 3)])
def test_against_all_windows(spark, monkeypatch, keep, gather):
    monkeypatch.setattr(S, "_GATHER", gather)
    monkeypatch.setattr(S, "_ROWS", 7)
    rows = corpus()
    docs = spark.createDataFrame([(t, k, 1) for k, t in rows], "text string, doc_id long, q long").repartition(6)
    got = {r[0]: tuple(r)[1:5] for r in S.suffix_dedup(docs, keep=keep).collect()}
    want = plain(rows, 400, keep)
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}
    assert len(got) == len(want)


def naive_factors(rows, lo, hi, group, position, middle):
    m = len(rows)
    previous, other = np.zeros((m, middle + 1), int), np.zeros((m, middle + 1), int)
    for i in range(m):
        for j in range(m):
            if i != j and group[i] == group[j]:
                for s in range(max(lo[i], lo[j]), middle + 1):
                    a, b = bytes(rows[i, s : hi[i]]), bytes(rows[j, s : hi[j]])
                    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                    if n > middle - s:
                        other[i, s] = max(other[i, s], n)
                        if position[j] < position[i]:
                            previous[i, s] = max(previous[i, s], n)
    return previous, other


@pytest.mark.parametrize("seed", range(12))
def test_factors(seed):
    """The array of longest previous factors against all pairs of suffixes, whole and from a length on."""
    rng = np.random.default_rng(seed)
    m, middle, width = 40, 12, 30
    base = rng.integers(0, 2 + seed % 3, (4, width))
    rows = base[rng.integers(0, 4, m)].astype(np.uint8)
    noise = rng.random((m, width)) < 0.06
    rows[noise] = 7
    rows[:, middle : middle + 3] = 9  # the gram
    lo, hi = np.where(rng.random(m) < 0.3, rng.integers(0, middle, m), 0), np.where(rng.random(m) < 0.3, rng.integers(middle + 3, width, m), width)
    rows[np.arange(width) < lo[:, None]] = 0
    rows[np.arange(width) >= hi[:, None]] = 0
    group, position = np.sort(rng.integers(0, 3, m)) * 10, rng.permutation(m)
    want = naive_factors(rows, lo, hi, group, position, middle)
    for got, exact in zip(factors(rows, lo, hi, group, position, middle, 1), want, strict=True):
        assert (got == exact).all()
    for least in (8, 14, 20):
        for got, exact in zip(factors(rows, lo, hi, group, position, middle, least), want, strict=True):
            assert ((got >= least) == (exact >= least)).all() and (got[exact >= least] == exact[exact >= least]).all()


def test_ranges():
    assert [len(S.ranges(400, k)) for k in range(S.levels(400) + 1)] == [1, 4, 16, 64, 256, 273]
    for k in range(1, 6):
        inner, outer = S.ranges(400, k), S.ranges(400, k - 1)
        assert inner[0][0] == 0 and inner[-1][1] == 272 and all(b[0] == a[1] + 1 for a, b in zip(inner, inner[1:], strict=False))
        assert all(any(x <= a and b <= y for x, y in outer) for a, b in inner)


def test_repeated_rows(spark):
    """Rows of one id and text: one of them is the first, the others are later copies."""
    rng = random.Random(9)
    passage, own = ("".join(rng.choices("abcdefgh ", k=n)) for n in (600, 900))
    rows = [(5, own + passage), (5, own + passage), (9, "x" * 50 + passage), (7, "short"), (7, "short"), (-(1 << 62), "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted((r["doc_id"], r["n_removed"], r["n_spans"], len(r["kept"])) for r in S.suffix_dedup(docs).collect())
    assert first == [(-(1 << 62), 0, 0, 4), (5, 0, 0, 1500), (5, 1500, 1, 0), (7, 0, 0, 5), (7, 0, 0, 5), (9, 600, 1, 50)]
    none = sorted((r["doc_id"], r["n_removed"]) for r in S.suffix_dedup(docs, keep="none").collect())
    assert none == [(-(1 << 62), 0), (5, 1500), (5, 1500), (7, 0), (7, 0), (9, 600)]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_thousands_of_repeated_rows(spark, keep):
    """They go through the search once, whatever their number: buckets hold classes, and no list grows with copies."""
    rng = random.Random(10)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    one, passage = text(1400), text(700)
    rows = [(5, one)] * 5000 + [(None, one)] * 3000 + [(6, "tiny")] * 2000 + [(k, text(300) + one[k : k + 500 + k] + text(200) + passage) for k in range(10, 60)]
    plainly = [*rows[:1], *rows[5000:5001], *rows[8000:8001], *rows[10000:]]
    want = plain([(-1 if k is None else k, t) for k, t in plainly], 400, keep)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = S.suffix_dedup(docs, keep=keep, text=False).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    rest = {-1 if r[0] is None else r[0]: tuple(r)[1:5] for r in got if r["count"] == 1}
    empty = hashlib.sha256(b"").hexdigest()
    gone = {(r[0], r[2]): r["count"] for r in got if r["count"] > 1}
    assert gone == ({(5, 1400): 5000, (None, 1400): 3000, (6, 0): 2000} if keep == "none" else {(5, 1400): 5000, (None, 1400): 2999, (6, 0): 2000})
    assert all(r["kept_sha256"] == empty for r in got if r["n_removed"] == 1400)
    if keep == "first":
        assert rest.pop(-1) == want[-1]
    assert rest == {k: x for k, x in want.items() if k >= 10}


def test_very_long_texts(spark):
    """Texts over a block of 1 MB, with passages that repeat within and across them."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefghijklm \n", k=n))
    p, q = text(700), text(450)
    rows = [(1, text(1_100_000) + p + text(900_000) + q + text(1000)), (2, text(300) + p + text(300)), (3, text(1_300_000) + q)]
    got = {r["doc_id"]: tuple(r)[1:5] for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="none").collect()}
    for k, t in rows:
        raw = t.encode()
        for x in (p, q):
            raw = raw.replace(x.encode(), b"")
        n, removed, spans, _ = got[k]
        # a byte next to a passage can be equal by chance on both sides
        assert n == len(t) and 0 <= removed - (len(t) - len(raw)) <= 6 and spans == sum(x in t for x in (p, q))


def test_blocks_of_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 101, 30_000, dtype=np.uint8))
    whole = S.anchors([text], 400)
    monkeypatch.setattr(S, "_BLOCK", 3000)
    parts = S.text_anchors(text, 400)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_edges(spark):
    long = "the quick brown fox " * 30
    docs = spark.createDataFrame([(None, long[:450]), (5, "x" + long[:450]), (6, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in S.suffix_dedup(docs, keep="none").collect()}
    assert got == {None: 450, 5: 450, 6: 0}
    assert S.suffix_dedup(docs.limit(0)).count() == 0


def plainly_covered(text, own, least):
    mask, middle = np.zeros(len(text), bool), least - S._GRAM
    for x in own or ():
        places = [np.ones(middle + 1, bool)] if x["bits"] is None else [np.unpackbits(np.frombuffer(b, np.uint8), count=middle + 1) > 0 for b in x["bits"]]
        for one in places:
            for s in np.flatnonzero(one) + x["q"] - middle:
                if 0 <= s <= len(text) - least:
                    mask[s : s + least] = True
    return mask


def test_removal_of_a_batch():
    """The windows of all texts of a batch at once, against each by itself; the calls that takes grow with neither texts nor windows."""
    rng, least, rows = np.random.default_rng(3), 400, []
    bits = lambda: np.packbits(np.repeat(rng.random(21) < 0.2, 13)).tobytes()
    for k in range(200):
        n = int(rng.integers(0, 3000)) if k % 9 else 0
        own = [{"q": int(rng.integers(0, n - S._GRAM)), "bits": None if rng.random() < 0.1 else [bits() for _ in range(rng.integers(0, 4))]} for _ in range(rng.integers(0, 12))] if n >= least else None
        rows.append((None if k % 27 == 0 else "x" * n, own))
    texts, own = pa.array(["in front", *(t for t, _ in rows)], pa.string())[1:], pa.array([x for _, x in rows], pa.list_(pa.struct([("q", pa.int64()), ("bits", pa.list_(pa.binary()))])))
    calls = []
    sys.setprofile(lambda frame, event, _: calls.append(event) if event in ("call", "c_call") else None)
    try:
        data, starts, ends = S.flat(texts)
        got = S.covered(data, starts, ends, own, least)
    finally:
        sys.setprofile(None)
    for (text, x), a, b in zip(rows, starts, ends, strict=True):
        assert b - a == len(text or "")
        assert (got[a:b] == plainly_covered(text or "", x, least)).all()
    assert got.any() and not got.all() and len(calls) < 200


def test_anchors_are_of_windows():
    """Every window has an anchor, equal windows have the same at the same places, and a text without windows has none, whatever lies beside it."""
    rng, least = np.random.default_rng(4), 400
    text = lambda n, letters=4: bytes(rng.integers(97, 97 + letters, n, dtype=np.uint8))
    one = text(900)
    texts = [text(399), one, b"", text(200) + one + text(150), b"a" * 1200, text(700, 2), text(127), text(400), b"ab" * 333]
    number, q, gram, _ = S.anchors(texts, least)
    for k, t in enumerate(texts):
        own = np.flatnonzero(number == k)
        assert (np.diff(q[own]) > 0).all()
        alone = S.anchors([t], least)
        assert [x.tolist() for x in alone[1:]] == [q[own].tolist(), gram[own].tolist(), S.anchors(texts, least)[3][own].tolist()]
        assert len(t) >= least or not len(own)
        for s in range(len(t) - least + 1):
            assert ((q[own] >= s) & (q[own] + S._GRAM <= s + least)).any()
    inner = lambda k, off: {(a - off, g) for a, g in zip(q[number == k].tolist(), gram[number == k].tolist(), strict=True) if off + 272 <= a < off + 900 - 400}
    assert inner(1, 0) == inner(3, 200) != set()


def test_texts_side_by_side(spark):
    """Texts that lose their ends lie beside each other in a batch: each counts its own bytes and runs. A batch of empty texts has none."""
    rng = random.Random(12)
    passage = "".join(rng.choices("abcdefgh ", k=500))
    rows = [(1, passage), (2, passage + "z" * 20), (3, None), (4, "y" * 20 + passage), (5, ""), (6, passage + "!" * 450 + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in S.suffix_dedup(docs, keep="none").collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5)} == {1: (500, 1), 2: (500, 1), 3: (0, 0), 4: (500, 1), 5: (0, 0)}
    assert got[6] == (1450, 1)  # the 450 bytes in between repeat as well
    none = S.suffix_dedup(docs.where("doc_id in (3, 5)"), keep="none").collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_spans"], r["kept"]) for r in none) == [(3, 0, 0, b""), (5, 0, 0, b"")]


def test_memory_of_anchors():
    """The arrays take 35 times the text (80 times before)."""
    texts = [np.random.default_rng(k).integers(97, 123, 2048, dtype=np.uint8).tobytes() for k in range(256)]
    S.anchors(texts, 400)  # the powers stay
    tracemalloc.start()
    try:
        S.anchors(texts, 400)
        assert tracemalloc.get_traced_memory()[1] < 50 * 256 * 2048
    finally:
        tracemalloc.stop()
