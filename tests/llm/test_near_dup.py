"""Near-dedup against all pairs of sets."""

import random
import re

import numpy as np

from palimpsest.llm.near_dup import likely, near_dup, registers
from palimpsest.llm.shingles import shingle_sets


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent):
    sets = [(k, plain_set(t)) for k, t in rows]
    comp = {k: k for k, _ in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {k: (len(s), root(k)) for k, s in sets}


def corpus(n=260):
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(400)]
    rows, base = [], [" ".join(rng.choices(vocab, k=rng.randint(1, 150))) for _ in range(25)]
    for k in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k * 3 % 1009, rng.choice([" ", "  ", "\n"]).join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "A b"), (2004, "a B"), (2005, "b a")]


def test_sets():
    rows = [t or "" for _, t in corpus(60)]
    flat, at = shingle_sets([t.encode() for t in rows])
    assert np.diff(at).tolist() == [len(plain_set(t)) for t in rows]


def test_blocks_give_the_same_hashes(monkeypatch):
    from palimpsest.llm import shingles as S

    texts = [(t or "").encode() for _, t in corpus(40)] + [b"x" * 500 + b" y", b" " * 300, b"", b"a b " * 200]
    whole = S.word_hashes(texts)
    for size in (1, 7, 64, 400):
        monkeypatch.setattr(S, "_BLOCK", size)
        parts = S.word_hashes(texts)
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all(), size


def test_components(spark):
    rows = corpus()
    for percent in (85, 60):
        docs = spark.createDataFrame([(t, k, "x") for k, t in rows], "text string, doc_id long, comp string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup(docs, percent=percent).collect()}
        want = brute(rows, percent)
        assert got == {k: v for k, v in want.items()}


def test_likelihood_keeps_similar_pairs():
    rng = np.random.default_rng(5)
    for share in (0.95, 0.87):
        n = 400
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        common = round(2 * n * share / (1 + share))
        y = np.concatenate([x[:common], rng.integers(0, 1 << 63, n - common, dtype=np.uint64)])
        r = registers(np.concatenate([x, y]), np.array([0, n, 2 * n]))
        assert likely(r[:1], r[1:], np.array([n]), np.array([n]), 0.85)[0]
    far = registers(rng.integers(0, 1 << 63, 800, dtype=np.uint64), np.array([0, 400, 800]))
    assert not likely(far[:1], far[1:], np.array([400]), np.array([400]), 0.85)[0]


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dup(docs).collect()), key=str) == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)], key=str)
    assert near_dup(docs.limit(0)).count() == 0


def test_registers_merge_and_agree_as_often_as_jaccard():
    """Registers of a union are the maxima of registers; equal registers are about as frequent as the sets are alike."""
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 5, 300, 1200, 2500)]
    rows = lambda own: registers(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]))
    each = rows(sets)
    for i in range(len(sets)):
        for j in range(i):
            union = rows([np.union1d(sets[i], sets[j])])[0]
            assert (union == np.maximum(each[i], each[j])).all()
    for share in (0.5, 0.8, 0.95):
        same = total = 0
        for k in range(60):
            own = np.random.default_rng(k).integers(0, 1 << 63, 2000, dtype=np.uint64)
            only = int(1000 * (1 - share) / (1 + share) / 1)
            a, b = own[: 1000], np.concatenate([own[: 1000 - only], own[1000 : 1000 + only]])
            jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = rows([np.sort(a), np.sort(b)])
            same += int((x == y).sum())
            total += len(x)
        assert abs(same / total - jaccard) < 0.03, (share, jaccard, same / total)


def test_very_long_texts(spark):
    """Texts of over a block of 1 MB are compared whole: a pair alike only in its first megabyte is no link."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    head = words(220_000)
    tail, other = words(120_000), words(120_000)
    near = list(head + tail)
    for k in range(0, len(near), 4000):
        near[k] = "changed"
    rows = [(1, " ".join(head + tail)), (2, " ".join(near)), (3, " ".join(head + other)), (4, " ".join(words(50)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dup(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert len(rows[0][1]) > 1 << 21 and got == {1: 1, 2: 1, 3: 3, 4: 4}
