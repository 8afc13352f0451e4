"""Quality statistics against plain Python, and the learned list on held-out labels."""

import random
import re

from palimpsest.llm.quality import BASE, learn, quality_rules, train


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, t in enumerate(tri):
        if tri.count(t) > 1:
            hit.update((i, i + 1, i + 2))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 9))) for _ in range(300)]
    rows = []
    for k in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 160))
        bad = rng.random() < 0.3
        if bad and k % 2:
            words = [w + "%%%" for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        for i in range(len(words) // 12):
            words[i * 12] += "\n"
        rows.append((k, " ".join(words), int(not bad)))
    return rows


def test_stats_and_rules(spark):
    rows = corpus(400, 1)
    odd = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "a b c a b c\na b c\n\na b c\n\n"), (9005, "x"), (9006, "same same same same same"), (9001, None), (None, "é & ü\x0b<x>\x0c| 5!")]
    docs = spark.createDataFrame([(k, t, 7, "z") for k, t, _ in rows] + [(k, t, 7, "z") for k, t in odd], "doc_id long, text string, n_words int, rule string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows[:250]] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    rules = train(docs, labels)
    assert rules.rules
    out = quality_rules(docs, rules).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in BASE)) for r in out), key=str) == sorted(((k, *plain(t)) for k, t in [(a, b) for a, b, _ in rows] + odd), key=str)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    held = {k: q for k, _, q in rows[250:]}
    right = [(r["rule"] == 0) == bool(held[r["doc_id"]]) for r in out if r["doc_id"] in held]
    assert sum(right) / len(right) > 0.97


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "w " * 20 + " ".join(f"w{i}" for i in range(90)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rules = train(docs, none)
    assert not rules.rules and quality_rules(docs, rules).first()["kept"]
    assert quality_rules(docs.limit(0), rules).count() == 0
    assert learn([], []).rules == ()


def test_very_long_texts_and_repeated_labels(spark):
    """A text of megabytes has the statistics of the whole; of several documents of an id the same one teaches in every run."""
    from palimpsest.llm.quality import quality_rules, train, DecisionList

    long = " ".join(f"w{k}" for k in range(300_000)) + " a b c a b c"
    rows = [(1, long), (2, "same words " * 200_000), (3, "x" * 2_000_000)]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), DecisionList(())).collect()}
    assert got == {1: (300_006, sum(len(f"w{k}") for k in range(300_000)) + 6, 6, False), 2: (400_000, 1_800_000, 400_000, True), 3: (1, 2_000_000, 0, True)}
    docs = [(k % 40, " ".join(["word", "###" if k % 2 else "text"] * 40 + [str(k)] + [f"v{j}" for j in range(60)])) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0)], "doc_id long, quality int")
    one, two = (str(train(spark.createDataFrame(d, "doc_id long, text string").repartition(n), labels, sample=30)) for d, n in ((docs, 3), (docs[::-1], 7)))
    assert one == two
