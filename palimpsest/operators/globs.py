"""Globs against paths, both of any number: patterns are indexed by what every path that they fit must have, and meet only those.

A pattern without wildcards fits one string. One whose last part has none fits paths with that name; others begin or end with some literal letters,
of which up to `_LETTERS` are the key. Only patterns that begin and end with a wildcard meet every path. What meets is then held against the whole pattern.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.materialize import stash

_LETTERS = 8
_SPECIAL = re.compile(r"[*?\[\]{},\\]")


def key_of(pattern: str) -> tuple[str, str]:
    """The kind of key and its value: = a whole path or name, n a name, t the end of a name, h the beginning of a path or name, * none."""
    at = [m.start() for m in _SPECIAL.finditer(pattern)]
    if not at:
        return "=", pattern
    head, tail = pattern[: at[0]], pattern[at[-1] + 1 :]
    # the slash of **/ at the beginning of a part may stand for nothing, but what follows begins a part
    free = pattern.endswith("**/" + tail[1:]) and tail.startswith("/") and (at[-1] < 2 or pattern[at[-1] - 2] == "/")
    if free or "/" in tail:
        name = tail.rsplit("/", 1)[-1]
        if name:
            return "n", name
        tail = "" if free else tail
    if tail and "/" not in tail:
        return "t", tail[-_LETTERS:]
    if tail:
        return "n", ""
    return ("h", head[:_LETTERS]) if head else ("*", "")


def indexed(patterns: DataFrame) -> DataFrame:
    """(pattern, regex, kind, key) of the distinct well-formed patterns of a column pattern."""

    def run(batches):
        for batch in batches:
            rows = [(p, rx, *key_of(p)) for p in batch.column(0).to_pylist() if p is not None and (rx := tx.glob_regex(p))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["pattern", "regex", "kind", "key"])

    return patterns.select("pattern").distinct().mapInArrow(run, "pattern string, regex string, kind string, key string")


def matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, pattern) of the distinct paths (a column path) and patterns (a column pattern) that fit: the whole path or its last part, as glob_match().
    Null paths and patterns and malformed patterns fit nothing; the empty path is a path."""
    known = stash(indexed(patterns), "patterns")
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.select("path").where("path is not null").distinct().withColumn("_name", name)
    of = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    sizes = F.sequence(F.lit(1), F.lit(_LETTERS))
    ends = F.transform(sizes, lambda k: of("t", F.right("_name", k)))
    begins = F.flatten(F.transform(sizes, lambda k: F.array(of("h", F.left("path", k)), of("h", F.left("_name", k)))))
    fixed = F.array(of("=", F.col("path")), of("=", F.col("_name")), of("n", F.col("_name")), of("*", F.lit("")))
    keys = stash(rows.select("path", "_name", F.explode(F.array_distinct(F.concat(fixed, ends, begins))).alias("k")).select("path", "_name", "k.kind", "k.key"), "path-keys")
    met = keys.join(known, ["kind", "key"]).where(F.expr("path rlike regex or _name rlike regex"))
    return met.select("path", "pattern").distinct()
