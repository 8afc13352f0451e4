"""Quality rules: a learned decision list over text statistics, as one Spark conditional expression.

Statistics are built-in functions over arrays of words and lines, without a shuffle. The rules are learned on the driver
from the statistics of a bounded sample of labelled documents, by sequential covering: grow a conjunction
of thresholds on one part of the sample by information gain, prune it on the other, keep it if it is precise
enough, take away what it covers, and go on. A document that a rule covers is rejected; the rest is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.llm.common import SPACE, SPACE_CHARS, computed_once, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = (*BASE, "n_lines", "n_marks", "n_capitals", "n_digits")
#: What rules may test: hundredths of one statistic to another, so that texts of all lengths compare.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "repeated_words": ("n_repeat_words", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"), "marks_per_word": ("n_marks", "n_words"), "capitals": ("n_capitals", "word_chars"), "digits": ("n_digits", "word_chars"),
}


def with_stats(docs: DataFrame, text_col: str, prefix: str = "_q_") -> DataFrame:
    """docs and the statistics of text_col (long), named with prefix."""
    p = prefix
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    # each step refers to the last one's arrays more than once, so that Catalyst leaves them computed
    one = docs.select(
        *own, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+", -1)).alias(f"{p}words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "").alias(f"{p}lines"),
        *(F.regexp_count(text, F.lit(pattern)).cast("long").alias(p + name) for name, pattern in (("n_symbols", "[#*$%&|<>]"), ("n_marks", "[!?]"), ("n_capitals", "[A-Z]"), ("n_digits", "[0-9]"))),
    )
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    n = F.size(words)
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    counted = [f"{p}n_symbols", f"{p}n_marks", f"{p}n_capitals", f"{p}n_digits"]
    two = one.select(
        *own, *counted, n.cast("long").alias(f"{p}n_words"), F.char_length(F.array_join(words, "")).cast("long").alias(f"{p}word_chars"),
        F.size(lines).cast("long").alias(f"{p}n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")).alias(f"{p}windows"),
    )
    windows = F.col(f"{p}windows")
    counted += [f"{p}n_words", f"{p}word_chars", f"{p}n_lines", f"{p}n_dup_lines"]
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    # windows by hash, then place: those equal to a neighbour are found twice or more
    three = two.select(*own, *counted, F.when(repeated, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(f"{p}order"))
    order = F.col(f"{p}order")
    again = F.filter(order, lambda x, k: (x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"]))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n")), lambda acc: acc["n"],
    )
    stats = {c: F.col(c) for c in counted} | {f"{p}n_repeat_words": F.coalesce(F.when(order.isNotNull(), covered), F.lit(0)).cast("long")}
    return computed_once(three, stats).drop(f"{p}order")


@dataclass(frozen=True)
class Test:
    """A threshold on a ratio: over it, or not."""

    ratio: str
    over: bool
    cut: float

    def holds(self, value: float) -> bool:
        return (value > self.cut) == self.over

    def column(self, prefix: str) -> Column:
        value = ratio(self.ratio, prefix)
        return value > self.cut if self.over else value <= self.cut


def ratio(name: str, prefix: str) -> Column:
    a, b = RATIOS[name]
    return 100.0 * F.col(prefix + a) / F.greatest(F.col(prefix + b), F.lit(1))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document is rejected by the first that covers it."""

    rules: tuple[tuple[Test, ...], ...]

    def column(self, prefix: str = "_q_") -> Column:
        """The number of the covering rule, from 1; 0 for none."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = rule[0].column(prefix)
            for t in rule[1:]:
                holds &= t.column(prefix)
            out = F.when(holds, k) if out is None else out.when(holds, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{t.ratio} {'>' if t.over else '<='} {t.cut:g}" for t in r) for r in self.rules) or "keep all"


def learn(rows: list[dict], bad: list[bool], precision: float = 0.97, least: int = 4, cuts: int = 64, most_rules: int = 12) -> DecisionList:
    """Sequential covering over rows of ratios. Sets of rows are bits of integers."""
    n = len(rows)
    if not n or not any(bad):
        return DecisionList(())
    full = (1 << n) - 1
    target = sum(1 << k for k in range(n) if bad[k])
    grow = sum(1 << k for k in range(n) if k % 3)  # rows come in the order of a hash
    tests: list[tuple[Test, int]] = []
    for name in RATIOS:
        values = [r[name] for r in rows]
        known = sorted(set(values))
        step = max(1, len(known) // cuts)
        for k in range(0, len(known) - 1, step):
            gaps = [(known[j + 1] - known[j], j) for j in range(k, min(k + step, len(known) - 1))]
            j = max(gaps)[1]  # the widest gap nearby
            cut = (known[j] + known[j + 1]) / 2
            over = sum(1 << i for i in range(n) if values[i] > cut)
            tests += [(Test(name, True, cut), over), (Test(name, False, cut), full ^ over)]
    rules, left, tried = [], full, set()
    while len(rules) < most_rules and len(tried) < most_rules:
        rule, cover = [], left
        while True:
            own = cover & grow
            p0, n0 = (own & target).bit_count(), (own & ~target & full).bit_count()
            if not p0 or not n0 or len(rule) == 4:
                break
            base, best = math.log2(p0 / (p0 + n0)), (0.0, None, 0)
            for t, bits in tests:
                p1 = (own & bits & target).bit_count()
                if p1 >= least and (rule or t not in tried):
                    gain = p1 * (math.log2(p1 / (own & bits).bit_count()) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, t, bits)
            if best[1] is None:
                break
            rule.append((best[1], best[2]))
            cover &= best[2]

        def worth(k: int) -> float:
            bits = left & full & ~grow
            for _, b in rule[:k]:
                bits &= b
            p = (bits & target).bit_count()
            return (2 * p + 1) / (bits.bit_count() + 2)

        if not rule:
            break
        # the shortest of the best
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (round(worth(k), 9), -k))]
        bits = left
        for _, b in rule:
            bits &= b
        p = (bits & target).bit_count()
        if p < least or p < precision * bits.bit_count():
            tried.add(rule[0][0])  # no good start; another may be
            continue
        rules.append(tuple(t for t, _ in rule))
        left &= ~bits
    return DecisionList(tuple(rules))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, min_words: int = 50, **how) -> DecisionList:
    """Rules from at most `sample` labelled documents, those with the smallest hash of their id. A label of 0 is a document
    to reject, 1 one to keep; others count as none, and of several labels of an id the least counts. Documents that fail the
    base conditions teach nothing, as no rule needs to judge them. Of several documents of an id, the one of the smallest hash
    of its text teaches."""
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    chosen = labels.withColumn("_hash", F.xxhash64("_id")).orderBy("_hash", "_id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_hash", "_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t")))["t"].alias("_text"))
    stats = with_stats(texts, "_text").where(~base_failed(min_words)).select("_hash", "_id", "_label", *(ratio(r, "_q_").alias(r) for r in RATIOS))
    rows = sorted(stats.collect(), key=lambda r: tuple(r))  # one an id, so at most `sample`
    return learn([r.asDict() for r in rows], [r["_label"] == 0 for r in rows], **how)


def base_failed(min_words: int, prefix: str = "_q_") -> Column:
    return (F.col(prefix + "n_words") < min_words) | (100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words"))


def quality_rules(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with the statistics, ratios' rule number `rule` (int, 0: none), base_failed and kept (boolean) added.

    base_failed: fewer than min_words words, or more than half of them in windows of three words found twice or
    more. kept: not base_failed and covered by no rule. Words are runs without space and code points 9 to 13.

    Null or empty text: no words, so base_failed. Null ids and repeated rows: judged like any row. Very long texts: read whole,
    within the memory that a few times their words take. Empty table: empty result. Columns of docs with the names of added ones are replaced; all others stay.
    """
    added = {*STATS, "rule", "base_failed", "kept"}
    own = [c for c in docs.columns if c.lower() not in added or c in (id_col, text_col)]
    out = with_stats(docs.select(*[f"`{c.replace('`', '``')}`" for c in own]), text_col)
    failed = base_failed(min_words)
    out = out.withColumn("_q_rule", rules.column())
    return out.select(*[f"`{c.replace('`', '``')}`" for c in own], *(F.col(f"_q_{s}").alias(s) for s in STATS), F.col("_q_rule").alias("rule"), failed.alias("base_failed"), (~failed & (F.col("_q_rule") == 0)).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")
