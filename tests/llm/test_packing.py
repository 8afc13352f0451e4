"""Packing against a plain reading of its contract."""

import itertools
import zlib

import numpy as np
import pytest

from palimpsest.llm.packing import Plan, Sums, best_fit_pack, sequences
from palimpsest.llm.tokens import Encoder, default_path


def test_encoder_is_the_librarys():
    rng = np.random.default_rng(1)
    bits = ["a", "é", "Foo", " ", "  ", "\n", "\t", ".", ",", "s", "'", "12", "\xa0", "\r\n", "$$", "ß", "日本", "<|endoftext|>", "_", "|", "\x1c", "-", "don't", "😀"]
    e = Encoder(default_path(), most=50)
    for _ in range(3000):
        text = "".join(rng.choice(bits, rng.integers(0, 14)))
        assert e.encode(text) == e.whole(text), repr(text)


@pytest.mark.parametrize("n,high", [(0, 5), (1, 10), (3000, 2048), (5000, 40), (2000, 1100)])
def test_plan_places_every_piece_once(n, high):
    lengths = np.random.default_rng(n).integers(1, high + 1, n)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = Plan(counts, 2048)
    held = {}
    for length, (first, seq, off) in plan.arrays().items():
        for r in range(counts[length]):
            k = np.searchsorted(first, r, "right") - 1
            held.setdefault(int(seq[k] + r - first[k]), []).append((int(off[k]), length))
    assert len(held) == plan.sequences
    for slots in held.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert plan.sequences <= -(-int(lengths.sum()) // 2048) * 1.1 + 1 or (lengths > 1024).sum() >= plan.sequences * 0.9


@pytest.mark.parametrize("seed", range(8))
def test_sums_against_brute_force(seed):
    """Whatever is taken away, a sum has a combination iff some one, two or three pieces make it."""
    rng = np.random.default_rng(seed)
    left = np.zeros(61, dtype=np.int64)
    left[rng.integers(1, 61, 14)] = rng.integers(1, 4, 14)
    sums = Sums(left)
    while left.any():
        pieces = np.repeat(np.arange(61), np.minimum(left, 3)).tolist()
        for n, find in ((1, sums.single), (2, sums.pair), (3, sums.triple)):
            possible = {sum(c) for c in itertools.combinations(pieces, n)}
            for total in range(1, 61):
                got = find(total)
                assert (got is not None) == (total in possible), (n, total)
                assert got is None or sum(got) == total and len(got) == n and all(left[x] >= got.count(x) for x in got)
                if got and n > 1 and rng.random() < 0.02:
                    for x in got:
                        left[x] -= 1
                    pieces = np.repeat(np.arange(61), np.minimum(left, 3)).tolist()
                    possible = {sum(c) for c in itertools.combinations(pieces, n)}
        left[rng.choice(np.flatnonzero(left))] -= 1 if left.any() else 0


def test_pack(spark):
    long = "word and more, " * 3000
    rows = [(1, "a b c", 5), (2, long, 6), (3, None, 7), (4, "", 8), (4, "", 8), (None, "x", 9), (7, long[: len(long) // 2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = best_fit_pack(docs).toPandas()
    e = Encoder(default_path())
    want = []
    for key, text, _ in rows:
        ids = np.frombuffer(e.whole(text or ""), "<u4").tolist() + [0]
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)] if len(ids) > 2048 else [0]
        for k, s in enumerate(starts):
            part = ids[s : (starts[k + 1] if k + 1 < len(starts) else len(ids))]
            want.append((key, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: (r[0] is None, r)
    have = [(None if a != a else int(a), *map(int, b)) for a, *b in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 2048
    one = docs.where("doc_id in (1, 2, 7)")
    placed = best_fit_pack(one)
    whole = sequences(one, placed).toPandas()
    assert whole.ids.map(len).sum() == placed.agg({"length": "sum"}).first()[0]
    assert best_fit_pack(docs.limit(0)).count() == 0


def test_encoder_keeps_words_in_use():
    e, asked = Encoder(default_path(), most=40), []
    word = e.later.word
    e.later.word = lambda x: asked.append(x) or word(x)
    for k in range(26 * 26):
        text = f"a common {chr(97 + k // 26)}q{chr(97 + k % 26)}x, words"
        assert e.encode(text) == e.whole(text)
    assert asked.count(" common") == asked.count(" words") == 1
    assert not any(x[-1:] == "," for x in (*e.later, *e.later.old)) and len(e.later) + len(e.later.old) <= 40
