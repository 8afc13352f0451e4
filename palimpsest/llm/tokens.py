"""Token ids of public tokenizers, at the speed that a corpus needs."""

from __future__ import annotations

import re
from array import array
from sys import byteorder

from palimpsest.llm.common import quiet_shards

#: Punctuation that the vocabulary's split pattern always parts from the letters before it; the apostrophe can begin a suffix like 's.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space besides space and 9 to 13 (or what one of the libraries takes for it): texts that hold it are encoded in one piece.
_RARE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\u205f\u3000"
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
#: Byte-level vocabularies write a byte as a character: printable ones as they are, the others in order from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PLAIN} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(_BYTE_CHARS[32])
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_LONGEST = 64


class _Memo(dict):
    """Chunk to its ids as bytes. When half of what it may hold is new, it forgets what was not asked for since the last time. Of a word
    that comes with punctuation and is new, the word alone is kept."""

    def __init__(self, encode, word, prefix: str, most: int):
        super().__init__()
        self.encode, self.word, self.prefix, self.half, self.bare = encode, word, prefix, max(most // 2, 1), self
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            stem = chunk.rstrip(_TAIL)
            if not (stem.isalpha() and (stem.isascii() or max(stem) < "\u2000")):
                ids = self.encode(self.prefix + chunk)
            elif len(stem) < len(chunk):
                known = stem in self
                ids = self[stem] + self.bare[chunk[len(stem) :]]
                if not known:
                    return ids
            else:
                ids = self.word(self.prefix + chunk)
        if len(chunk) <= _LONGEST:
            if len(self) >= self.half:
                self.old = self.copy()
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit integers.

    The file's split pattern never joins what is on both sides of a single space or line break that stands
    between other characters, so each chunk between such places is encoded by the library once and then
    remembered. The ids are the library's for the whole text; tests compare the two. Texts with the
    file's special tokens or unusual white space go to the library whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        quiet_shards()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.own = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        word = self.letters if all(self.letters(w) == self.whole(w) for w in ("a", " word", "Été", " überall", " слово")) else self.whole
        self.first = _Memo(self.whole, word, "", most // 5)
        self.later = _Memo(self.whole, word, " ", most)
        self.later.bare = self.first

    def letters(self, word: str) -> bytes:
        """Ids of letters after at most one space, which the split pattern leaves together: the library's merges alone."""
        if word.isascii():  # nothing but the space is written otherwise
            word = word.replace(" ", _SPACE)
        else:
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        own = self.own
        return b"".join([own[t.id] for t in self.tokenize(word)])

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        ids = array("I", ids)
        if byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.special) or not text.isascii() and any(c in text for c in _RARE) or any(c in text for c in _RARE[:4]):
            return self.whole(text)
        first, later = self.first.__getitem__, self.later.__getitem__
        if any(x in text for x in _UNEVEN):
            return b"".join([later(c[1:]) if c[0] == " " and len(c) > 1 and c[1] not in " \t\n\r\x0b\x0c" else first(c) for c in _CHUNKS.findall(text)])
        parts: list[bytes] = []
        line_break = first("\n")
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if n:
                parts.append(line_break)
            if words[0]:
                parts.append(first(words[0]))
            parts.extend(map(later, words[1:]))
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file: its memory of chunks outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
