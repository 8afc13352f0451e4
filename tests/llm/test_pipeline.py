"""The pipeline's stages against plain readings of them, and its edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from palimpsest.llm import mixing, quality


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefgé", k=rng.randint(3, 9))) for _ in range(900)]
    shared = [" ".join(rng.choices(vocab, k=8)) for _ in range(4)]
    rows, labels = [], []
    for k in range(240):
        bad = rng.random() < 0.2
        words = rng.choices(vocab, k=rng.randint(60, 200))
        if bad:
            words = [w + "%%%" for w in words]
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        if k % 3 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(shared))
        text = "\n".join(lines)
        if k % 17 == 5 and rows and not bad:
            text = rows[-1][1]
        rows.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1"]), len(text), "x"))
        labels.append((k, int("%%%" not in text)))
    rows += [(None, rows[0][1], "en", "src0", 5, "x"), (900, None, "en", "src0", 0, None), (901, "", None, None, None, None)]
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def lines_plain(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if k is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(k)
    out = []
    for k, t in rows:
        keep = [x for x in (t or "").split("\n") if k is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == k]
        out.append((k, "\n".join(keep)))
    return out


def near_plain(rows):
    def own(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, comp = {k: own(t) for k, t in rows if k is not None}, {}
    for k in sorted(sets):
        near = [j for j in comp if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j])]
        roots = {comp[j] for j in near} | {k}
        comp[k] = min(roots)
        comp = {j: min(roots) if c in roots else c for j, c in comp.items()}
    return [(k, t) for k, t in rows if k is None or comp[k] == k]


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        before = rows_of(docs) if k < 4 else docs.count()
        after = stage(spark, docs, corpus)
        if k < 4:
            assert after.columns == columns
        after = spark.createDataFrame(after.collect(), after.schema)
        if k == 0:
            rules = quality.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
            assert rules.rules
            kept = rows_of(after)
            assert all("%%%" not in t for _, t in kept)
            assert set(kept) == {(a, t) for a, t in before if t and "%%%" not in t and len(t.split()) >= 50}
        elif k == 1:
            assert sorted(rows_of(after), key=str) == sorted(lines_plain(before), key=str)
        elif k == 2:
            assert sorted(rows_of(after), key=str) == sorted(near_plain([(a, t) for a, t in before]), key=str)
        elif k == 3:
            stay = {tuple(r) for r in mixing.mix_sources(docs).where("kept").select("doc_id", "text").collect()}
            assert set(rows_of(after)) == stay and 0 < len(stay) < len(before)
        else:
            assert after.select("doc_id").distinct().count() == before
        docs = after


def test_clashing_columns_stay(spark, corpus):
    """Extra columns come out of four stages as they went in, whatever their names."""
    names = ["kept", "rule", "n_words", "Base_Failed", "n_lines", "n_dropped", "cell", "weight", "probability", "n_tokens", "a.b", "b`c", "_row", "_pipeline_others", "times", "_id", "KEEP me"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet").drop("_row")
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{k}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))))
    columns = docs.columns
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = docs.collect()
    assert len(rows) > 20
    at = [columns.index(n) for n in names]
    assert all([r[i] for i in at] == [f"{k}-{r['doc_id']}" for k in range(len(names))] for r in rows)
    assert P.pack(spark, docs, corpus).count() >= len(rows)


def test_run_and_empty(spark, corpus, tmp_path):
    assert P.run(spark, corpus).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
