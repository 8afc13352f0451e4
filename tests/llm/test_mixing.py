"""Mixing: margins after raking, counts of kept documents, and defined cases."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm.mixing import TARGETS, calibrate, expected_margins, mix_sources, op6_mix_sources, rake, uniform


def test_rake_meets_margins():
    rng = random.Random(1)
    names = tuple(TARGETS)
    cells = [(s, la, t) for s in TARGETS["source"] for la in TARGETS["lang"] for t in TARGETS["topic"]]
    tokens = {c: rng.uniform(1, 1000) for c in cells}
    share = rake(tokens, names, TARGETS)
    for k, name in enumerate(names):
        for value, goal in TARGETS[name].items():
            assert abs(sum(s for c, s in share.items() if c[k] == value) - goal) < 1e-6
    total = sum(tokens.values())
    for budget in (0.001, 0.05, 0.5, 0.8, 1.0):
        mix = calibrate(tokens, share, names, budget)
        assert abs(sum(tokens[c] * p for c, p in mix.chances.items()) / total - budget) < 1e-6
    low = calibrate(tokens, share, names, 0.001)
    for k, name in enumerate(names):
        kept = {v: sum(tokens[c] * p for c, p in low.chances.items() if c[k] == v) / total / 0.001 for v in TARGETS[name]}
        assert all(abs(kept[v] - TARGETS[name][v]) < 1e-5 for v in kept)
    assert rake({}, names, TARGETS) == {}


def test_documents(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(1, 900)) + "\n" * rng.randint(0, 80), rng.choice(["en", "fr", "de", "es", "xx", None]), rng.choice(["src0", "src1", "src2", None]), 5.0) for k in range(3000)]
    rows += [(None, None, None, None, 1.0), (9000, "", "en", "src0", 1.0), (9000, "", "en", "src0", 1.0), (9001, "a | b | c | d", "en", "src0", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight double")
    goals = TARGETS | {"topic": {"list": 0.4, "short": 0.2, "long": 0.4}}
    out = mix_sources(docs, goals, budget=0.02).cache()
    got = out.collect()
    assert len(got) == len(rows) and all(r["kept"] is not None and 0 <= r["probability"] <= 1 for r in got)
    words = {r["doc_id"]: r["n_tokens"] for r in got}
    assert all(words[k] == len((t or "").split()) for k, t, *_ in rows)
    for name in ("source", "lang"):
        for value, share in expected_margins(out, name).items():
            assert abs(share - goals[name][value]) < 0.02, (name, value)
    want = sum(r["probability"] for r in got)
    assert abs(sum(r["kept"] for r in got) - want) < 6 * want**0.5
    assert [r for r in mix_sources(docs).collect() if r["doc_id"] == 9001][0]["cell"]["topic"] == "table"
    again = {r["doc_id"]: r["kept"] for r in mix_sources(docs.repartition(7), goals, budget=0.02).collect()}
    assert again == {r["doc_id"]: r["kept"] for r in got}
    assert mix_sources(docs.limit(0)).count() == 0


def test_every_source_has_a_target(spark, monkeypatch):
    from palimpsest.llm import mixing

    # no src0, a hot src7, and a null source; all of one language and topic
    sizes = {"src7": 1600, "src1": 400, "src2": 100, "src3": 100, None: 25}
    rows = [(k, "w " * 10, "en", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    roots = {s or "other": n**0.5 for s, n in sizes.items()}
    out = mix_sources(docs, budget=0.05).cache()
    got = expected_margins(out, "source")
    assert set(got) == set(roots) and all(abs(got[s] - r / sum(roots.values())) < 1e-6 for s, r in roots.items())
    more = docs.unionByName(spark.createDataFrame([(9000 + k, "w " * 10, "en", "src0") for k in range(700)], docs.schema))
    got = expected_margins(mix_sources(more, budget=0.05), "source")
    assert abs(got["src0"] - 0.25) < 1e-6 and abs(got["src7"] - 0.75 * 40 / sum(roots.values())) < 1e-6
    monkeypatch.setattr(mixing, "MOST_LITERAL", 1)  # cells joined
    row = lambda r: (r["doc_id"], r["weight"], r["probability"], r["kept"])
    assert sorted(map(row, mix_sources(docs, budget=0.05).collect())) == sorted(map(row, out.collect()))


def plain(rows, uniforms):
    """What op6 gives for rows (doc_id, text, lang, source), by a plain reading: cells, tokens, fitted shares and who stays."""
    out, tokens = {}, {}
    for k, text, lang, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        bars, lines = (text or "").count("|"), (text or "").count("\n") + 1
        topic = "table" if 3 * bars >= max(n, 1) else "list" if 12 * lines >= max(n, 1) else "short" if n < 400 else "long"
        cell = (source if source is not None else "other", lang if lang in TARGETS["lang"] else "other", topic)
        out[k] = (n, cell)
        tokens[cell] = tokens.get(cell, 0) + n
    values = [sorted({c[k] for c in tokens}) for k in range(3)]
    grid = np.zeros([len(v) for v in values])
    for c, n in tokens.items():
        grid[tuple(v.index(x) for v, x in zip(values, c, strict=True))] = n
    total = grid.sum()
    by_source = dict(zip(values[0], grid.sum((1, 2)), strict=True))
    rest = {v: t**0.5 for v, t in by_source.items() if v != "src0" and t > 0}
    goals = [{"src0": 0.25} | {v: 0.75 * x / sum(rest.values()) for v, x in rest.items()}, TARGETS["lang"], TARGETS["topic"]]
    share = grid / total
    for _ in range(400):
        for k in range(3):
            axes = tuple(a for a in range(3) if a != k)
            margin = share.sum(axes)
            goal = np.array([goals[k].get(v, 0.0) for v in values[k]]) * (margin > 0)
            factor = np.divide(goal / goal.sum(), margin, out=np.zeros_like(margin), where=margin > 0)
            share = share * factor.reshape([-1 if a == k else 1 for a in range(3)])
    weight = np.divide(share * total, grid, out=np.zeros_like(grid), where=grid > 0)
    low, high = 0.0, 1e9  # the scale at which capped chances spend the budget
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if (np.minimum(1, weight * middle) * grid).sum() < 0.8 * total else (low, middle)
    chance = np.minimum(1, weight * high)
    at = lambda g, c: g[tuple(v.index(x) for v, x in zip(values, c, strict=True))]
    return {k: (n, c, at(weight, c), at(chance, c) if tokens[c] else 1.0, uniforms[k]) for k, (n, c) in out.items()}


def test_query_against_a_plain_reading(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    uniforms = {r[0]: r[1] for r in docs.select("doc_id", uniform(F.col("doc_id"), 17)).collect()}
    want = plain([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], uniforms)
    got = op6_mix_sources(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n, cell, weight, chance, u = want[r["doc_id"]]
        assert (r["n_tokens"], r["cell_source"], r["cell_lang"], r["cell_topic"]) == (n, *cell)
        assert abs(r["weight"] - weight) < 1e-5 * max(1, weight) and abs(r["probability"] - chance) < 1e-5
        assert r["kept"] == (u < chance) or abs(u - chance) < 1e-5


def test_very_long_texts(spark):
    rows = [(1, "w " * 600_000, "en", "src0"), (2, "a|b " * 200_000, "en", "src1"), (3, "x" * 3_000_000, "en", "src1")]
    got = {r["doc_id"]: (r["n_tokens"], r["cell"]["topic"]) for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {1: (600_000, "long"), 2: (200_000, "table"), 3: (1, "list")}
