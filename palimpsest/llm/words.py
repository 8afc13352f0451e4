"""Words of texts, runs of bytes without space and bytes 9 to 13, as 64-bit hashes, and hashes of their stretches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from palimpsest.llm.shingles import mix, pieces, powers

#: Bytes of text worked on at a time; the arrays take some 50 times as much.
BLOCK = 1 << 20
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, *range(9, 14)]] = False
_BYTES = mix(np.arange(256, dtype=np.uint64), 33)


def _hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a text, and the offset at which it ends."""
    data = np.frombuffer(text, dtype=np.uint8)
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = _IN_WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, last = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + mix((last - first).astype(np.uint64), 34)), last


def batches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of texts, hashes of their words, where the words of each begin among them and one more at the end), for runs of texts of at
    most BLOCK bytes together. A longer text is a run of its own, hashed in pieces that end where a word does."""
    own: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if own and size + len(text) + 1 > BLOCK:
            yield _batch(texts, own)
            own, size = [], 0
        own.append(k)
        size += len(text) + 1
    if own:
        yield _batch(texts, own)


def _batch(texts: list[bytes], own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers = np.array(own, dtype=np.int64)
    if len(own) == 1:
        hashes = np.concatenate([_hashes(x)[0] for x in pieces(texts[own[0]])])
        return numbers, hashes, np.array([0, len(hashes)])
    hashes, last = _hashes(b" ".join([texts[k] for k in own]))
    ends = np.cumsum([len(texts[k]) + 1 for k in own])
    return numbers, hashes, np.concatenate([[0], np.searchsorted(last, ends)])


class Stretches:
    """Hashes of stretches of a sequence of word hashes; those of equal words are equal, wherever they are."""

    def __init__(self, words: np.ndarray, salt: int):
        up, self.down = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mix(words, salt) * up[: len(words)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words from first to before last."""
        return mix((self.sums[last] - self.sums[first]) * self.down[first])
