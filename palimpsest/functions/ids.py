"""Identifiers: deterministic ids and hashes, as Columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def chunk_id(session: Column, turn: Column, sub: Column) -> Column:
    return F.concat_ws(":", session, turn.cast("string"), sub.cast("string"))


def topic_id(members: Column) -> Column:
    """Of an array of member ids, whatever their order."""
    return F.substring(F.sha2(F.concat(F.array_join(F.array_sort(members), "\n"), F.lit("\n")), 256), 1, 16)


def edge_id(kind: Column, a: Column, b: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", kind, a, b), 256), 1, 16)


def session_hash(file_sha: Column, messages: Column) -> Column:
    """Of a file's SHA-256 in hex and a count of messages as a little-endian 32-bit number."""
    h = F.lpad(F.hex(messages), 8, "0")
    little = F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))
    return F.sha2(F.concat(F.encode(file_sha, "UTF-8"), little), 256)


def summary_hash(model: str, ids_and_texts: Column) -> Column:
    """Of a model and an ordered array of struct(id, text): the hash of a hash."""
    body = F.concat(F.lit(f"{model}\n"), F.array_join(F.transform(ids_and_texts, lambda x: F.concat(x["id"], F.lit("|"), x["text"], F.lit("\n"))), ""))
    return F.sha2(F.unhex(F.sha2(body, 256)), 256)


def project_id(path: Column) -> Column:
    return F.translate(path, "/", "-")
