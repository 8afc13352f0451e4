"""Tokens of a byte-pair vocabulary: counts and windows of texts, for a file of ranks (base64 bytes and a number a line)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# How the cl100k vocabulary splits texts.
CL100K = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"

_known: dict[Bpe, object] = {}


@dataclass(frozen=True)
class Bpe:
    """path: a file that every executor has. special: names and ids of special tokens, which count as one where a text has them."""

    path: str
    pattern: str = CL100K
    special: tuple[tuple[str, int], ...] = ()

    def encoding(self):
        """One for each worker process."""
        if self not in _known:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _known[self] = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=dict(self.special))
        return _known[self]

    def cut(self, text: str, size: int, overlap: int) -> list[str]:
        """Windows of size tokens that overlap; a text of at most size tokens as it is. Windows that cut a character are left out."""
        e = self.encoding()
        ids = e.encode(text, allowed_special="all")
        if len(ids) <= size:
            return [text]
        out = []
        for start in range(0, len(ids), size - overlap):
            try:
                out.append(e.decode_bytes(ids[start : start + size]).decode())
            except UnicodeDecodeError:
                pass
            if start + size >= len(ids):
                break
        return out

    def count(self, c: Column) -> Column:
        """Tokens of a text (int); 0 for null."""

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            e = self.encoding()
            for texts in batches:
                yield pd.Series([len(e.encode(t, allowed_special="all")) if t else 0 for t in texts], dtype="int32")

        return F.pandas_udf(run, "int")(c)

    def windows(self, c: Column, size: int, overlap: int) -> Column:
        """cut() of a text as an array; empty for null."""

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([self.cut(t, size, overlap) if t is not None else [] for t in texts])

        return F.pandas_udf(run, "array<string>")(c)
