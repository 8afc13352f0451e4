"""Line dedup against a plain reading, and its SQL in DuckDB."""

import hashlib
import random

import duckdb
import pytest

from palimpsest.llm.line_dedup import SQL, line_dedup, op5_line_dedup


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows):
    holders = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if k is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if k is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == k]
        out.append((k, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def corpus():
    rng = random.Random(4)
    common = [f"This is shared line number {i} É" for i in range(12)] + ["short", "x" * 19, "y" * 20, "é" * 20]
    rows = []
    for k in range(150):
        lines = [rng.choice(common) if rng.random() < 0.3 else f"own line {k} {i} with some more text" for i in range(rng.randint(0, 12))]
        lines = [x.upper() if rng.random() < 0.2 else f" \t{x}\r" if rng.random() < 0.2 else x for x in lines]
        rows.append((k * 11 % 997, "\n".join(lines)))
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (None, common[0]), (2003, common[1] + "\n" + common[1]), (2003, common[1] + "\n" + common[1]), (2003, common[2]), (2004, "z" * 100_000)]
    return rows


def test_against_plain(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, k, 7, "r", k) for k, t in rows], "text string, doc_id long, n_lines int, _row string, _pos long").repartition(5)
    out = line_dedup(docs)
    assert out.columns == ["text", "doc_id", "_row", "_pos", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    assert line_dedup(docs.limit(0)).count() == 0


def test_sql(spark, tmp_path):
    rows = [(k, t) for k, t in dict(corpus()).items() if k is not None]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    mine = sorted(tuple(r) for r in op5_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert mine == sorted(db.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({SQL})").fetchall())
    assert mine == sorted((k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in plain(rows))


CONTRACT = {
    "op1_nearest": "query_id bigint, rank int, vec_id bigint, score double", "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string", "op5_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", "op8_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_best_fit_pack": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", "op10_near_dup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op11_source_divergence": "lang string, source string, part string, item string, value bigint, rank int", "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_queries(spark, name):
    from palimpsest.llm.registry import QUERIES

    have = dict(QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    for column in CONTRACT[name].split(", "):
        c, kind = column.split(" ")
        assert have[c] == kind, (name, c)
