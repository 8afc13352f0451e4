"""Sets of hashed word shingles, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, *range(9, 14)]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The 64-bit finalizer of the splitmix generator."""
    x = x + np.uint64(salt * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


#: Bytes of text hashed at a time; the arrays take some 50 times as much.
_BLOCK = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def pieces(text: bytes) -> list[bytes]:
    """A text in blocks that end where a word ends; a longer word is a block of its own."""
    out, at = [], 0
    while len(text) - at > _BLOCK:
        cut = max(text.rfind(c, at, at + _BLOCK) for c in (_SPACES[k : k + 1] for k in range(6)))
        if cut <= at:
            cut = min((x for x in (text.find(_SPACES[k : k + 1], at + _BLOCK) for k in range(6)) if x >= 0), default=len(text))
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word with A-Z lower-cased, and where the words of each text begin among them (one more at the end)."""
    parts, owner, held, size = [], [], [], 0
    counts = np.zeros(len(texts), dtype=np.int64)

    def done():
        if held:
            hashes, at = _word_hashes(held)
            parts.append(hashes)
            np.add.at(counts, owner, np.diff(at))
            held.clear()
            owner.clear()

    for k, text in enumerate(texts):
        for piece in pieces(text) if len(text) > _BLOCK else [text]:
            if size + len(piece) > _BLOCK:
                done()
                size = 0
            held.append(piece)
            owner.append(k)
            size += len(piece)
    done()
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of texts of a block."""
    data = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = _IS_WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, last = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(data.astype(np.uint64)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first] + mix((last - first).astype(np.uint64), 1))
    return hashes, np.concatenate([[0], np.searchsorted(first, ends)])


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another, and where each text's begin (one more at the
    end). A text of fewer words has its whole sequence as its one shingle; one without words has none."""
    words, at = word_hashes(texts)
    if not len(words):
        return words, np.zeros(len(texts) + 1, dtype=np.int64)
    full = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        full += mix(words[k : len(full) + k], k + 1) * np.uint64(2 * k + 3)
    full = mix(full)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(full[a : b - width + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = mix(words[a:b], 0) * (np.arange(b - a, dtype=np.uint64) * np.uint64(2) + np.uint64(3))
            sets.append(mix(short.sum(keepdims=True) + np.uint64(b - a), 99))
        else:
            sets.append(full[:0])
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
