"""Mixing sources to target weights: iterative proportional fitting of token weights, then Poisson sampling.

Documents fall into cells of source, language and topic, where values without a target of their own share one; in a margin
whose rest is dealt, as that of sources is by default, each value in the corpus gets a target, in proportion to a power
of its tokens. So there are as many cells as targets multiply to. One aggregation counts the tokens of
each cell; raking on the driver scales the cells until their margins meet the targets; a document then
stays with its cell's probability, decided by a hash of its id, so that reruns and other partitionings agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.llm.common import SPACE, SPACE_CHARS, computed_once, rest_of, table

OTHER = "other"
#: The targets of the query and of the pipeline's stage: shares of tokens. OTHER's share of sources is dealt.
TARGETS = {
    "source": {"src0": 0.25, OTHER: 0.75}, "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.14, OTHER: 0.01},
    "topic": {"table": 0.02, "list": 0.05, "short": 0.4, "long": 0.53},
}

#: The power of tokens by which a margin's rest is dealt: 1 keeps the corpus's balance, 0 makes all alike.
TEMPER = 0.5
#: Up to so many cells are looked up in a literal; beyond, joined.
MOST_LITERAL = 2000
#: Cells up to which their table is broadcast, and joined by shuffle beyond.
MOST_BROADCAST = 200_000


def count_words(text: Column) -> Column:
    """Words as runs without white space (long)."""
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"{SPACE}+", -1))).cast("long")


def topic_of(text: Column, n_words: Column) -> Column:
    """A topic by form, for corpora without topics: table (a bar to every three words), list (a line to every twelve
    words), short (under 400 words) or long."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    bars, lines = F.regexp_count(text, F.lit("[|]")), F.regexp_count(text, F.lit("\n")) + 1
    return F.when(3 * bars >= F.greatest(n_words, F.lit(1)), "table").when(12 * lines >= F.greatest(n_words, F.lit(1)), "list").when(n_words < 400, "short").otherwise("long")


@dataclass(frozen=True)
class Mix:
    """Weights of cells: by how much a token of the cell counts, and the chance that its documents stay."""

    names: tuple[str, ...]
    weights: dict[tuple[str, ...], float]
    chances: dict[tuple[str, ...], float]


def rake(tokens: dict[tuple[str, ...], float], names: tuple[str, ...], targets: dict[str, dict[str, float]], rounds: int = 200, tolerance: float = 1e-9) -> dict[tuple[str, ...], float]:
    """Shares of cells after iterative proportional fitting: the token shares, scaled to each margin's targets in turn.
    Targets without tokens are left out and the rest scaled up to 1."""
    total = sum(tokens.values())
    share = {c: t / total for c, t in tokens.items() if t > 0} if total else {}
    for _ in range(rounds):
        worst = 0.0
        for k, name in enumerate(names):
            margin: dict[str, float] = {}
            for c, s in share.items():
                margin[c[k]] = margin.get(c[k], 0.0) + s
            mass = sum(targets[name].get(v, 0.0) for v in margin)
            if not mass:
                continue
            factor = {v: targets[name].get(v, 0.0) / mass / s if s else 0.0 for v, s in margin.items()}
            worst = max([worst, *(abs(f - 1) for v, f in factor.items() if margin[v])])
            share = {c: s * factor[c[k]] for c, s in share.items()}
        if worst < tolerance:
            break
    return share


def calibrate(tokens: dict[tuple[str, ...], float], share: dict[tuple[str, ...], float], names: tuple[str, ...], budget: float) -> Mix:
    """Chances from raked shares: in proportion to the cells' weights, up to 1, so that `budget`, a share of all tokens,
    is expected to stay. Where no cell has less than it is asked for, margins meet the targets exactly; else such cells
    stay whole and the others make up the rest. Cells without tokens stay."""
    total = sum(tokens.values())
    weights = {c: share.get(c, 0.0) * total / t if t else 0.0 for c, t in tokens.items()}
    left, mass, scale = budget * total, sum(tokens[c] * w for c, w in weights.items()), 0.0
    for c in sorted(weights, key=lambda c: (-weights[c], c)):  # those that would be over 1 first
        if weights[c] <= 0:
            break
        scale = left / mass if mass > 0 else 0.0
        if scale * weights[c] <= 1:
            break
        left, mass = left - tokens[c], mass - tokens[c] * weights[c]
    if left > 0 and mass <= 1e-9 * total and scale:
        scale = math.inf
    chance = lambda w: 0.0 if w <= 0 else 1.0 if scale == math.inf else min(1.0, round(w * scale, 12))
    return Mix(names, {c: round(w, 12) for c, w in weights.items()}, {c: chance(w) if tokens[c] else 1.0 for c, w in weights.items()})


def cell_columns(targets: dict[str, dict[str, float]], columns: dict[str, Column], dealt: tuple[str, ...] = ()) -> dict[str, Column]:
    """Each margin's value, or OTHER where it is null or, in a margin that isn't dealt, has no target."""
    return {name: F.coalesce(columns[name] if name in dealt else F.when(columns[name].isin(*goal), columns[name]), F.lit(OTHER)) for name, goal in targets.items()}


def deal(goal: dict[str, float], tokens: dict[str, float], temper: float = TEMPER) -> dict[str, float]:
    """goal with OTHER's share dealt among the values of tokens without a target, in proportion to a power of their tokens."""
    own = {v: g for v, g in goal.items() if v != OTHER}
    rest = {v: t**temper for v, t in sorted(tokens.items()) if v not in own and t > 0}
    mass = math.fsum(rest.values())
    return own | {v: goal.get(OTHER, 0.0) * x / mass for v, x in rest.items()} if rest else goal


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1 by the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) * F.lit(2.0**-53)


def mix_sources(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", budget: float = 0.8, seed: int = 17, columns: dict[str, Column] | None = None,
    dealt: tuple[str, ...] | None = None,
) -> DataFrame:
    """docs and n_tokens (long), cell (struct of a string for each margin), weight, probability (double), kept (boolean).

    targets: for each margin the shares of its values; by default source, lang and topic. columns: a margin's values,
    by default the column of that name or, for topic where there is none, topic_of. budget: the share of all tokens that
    is expected to stay; kept documents' tokens meet the targets in expectation as far as cells have enough of them for
    it. A whole document stays or goes. dealt: margins in which OTHER's share is dealt among all values without a target
    (`deal`), by their tokens in all of docs; by default source with the default targets, and none with others.

    Nulls in a margin: OTHER. Null or empty text: no tokens; such a document doesn't count, and stays by its cell's
    chance, or always where the cell has no tokens. Null ids: all alike by hash. Repeated rows: kept alike. Very long texts: read whole. Empty table: empty result. Columns of docs with
    the names of added ones are replaced; all others stay.
    """
    dealt = dealt if dealt is not None else () if targets else ("source",)
    targets = targets or TARGETS
    names = tuple(targets)
    text = F.col(f"`{text_col}`")
    have = {c.lower(): c for c in docs.columns}
    given = columns or {}
    base = computed_once(docs, {"_mix_n": count_words(text)})
    own = {n: given[n] if n in given else F.col(f"`{have[n.lower()]}`").cast("string") if n.lower() in have else topic_of(text, F.col("_mix_n")) if n == "topic" else F.lit(None).cast("string") for n in names}
    cells = cell_columns(targets, own, dealt)
    base = computed_once(base, {"_mix_cell": F.struct(*(c.alias(n) for n, c in cells.items()))})
    counted = base.groupBy("_mix_cell").agg(F.sum("_mix_n").alias("n")).collect()
    tokens = {tuple(r["_mix_cell"]): float(r["n"]) for r in counted}
    for k, name in enumerate(names):
        if name in dealt:
            margin: dict[str, float] = {}
            for c, n in tokens.items():
                margin[c[k]] = margin.get(c[k], 0.0) + n
            targets = targets | {name: deal(targets[name], margin)}
    mix = calibrate(tokens, rake(tokens, names, targets), names, budget)
    weight, chance = F.lit(None).cast("double"), F.lit(None).cast("double")
    key = F.concat_ws("\x1f", *(F.col(f"_mix_cell.{n}") for n in names))
    if len(tokens) > MOST_LITERAL:
        plan = base.sparkSession.createDataFrame([("\x1f".join(c), w, mix.chances[c]) for c, w in sorted(mix.weights.items())], "_mix_key string, _mix_weight double, _mix_chance double")
        base = base.join(F.broadcast(plan) if len(tokens) <= MOST_BROADCAST else plan, key == F.col("_mix_key"), "left")
        weight, chance = F.col("_mix_weight"), F.col("_mix_chance")
    elif tokens:
        weight, chance = (F.create_map(*(F.lit(x) for c, v in sorted(m.items()) for x in ("\x1f".join(c), v)))[key] for m in (mix.weights, mix.chances))
    added = ("n_tokens", "cell", "weight", "probability", "kept")
    rows = base.withColumn("_mix_w", weight).withColumn("_mix_p", chance)
    return rows.select(
        *rest_of(docs, *(a for a in added if a not in (id_col, text_col))), F.col("_mix_n").alias("n_tokens"), F.col("_mix_cell").alias("cell"), F.col("_mix_w").alias("weight"), F.col("_mix_p").alias("probability"),
        (uniform(F.col(f"`{id_col}`"), seed) < F.col("_mix_p")).alias("kept"),
    )


def expected_margins(out: DataFrame, name: str) -> dict[str, float]:
    """Share of each value of a margin in the tokens that are expected to stay."""
    rows = out.groupBy(F.col(f"cell.{name}").alias("v")).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()
    total = math.fsum(r["t"] for r in rows)
    return {r["v"]: r["t"] / total for r in rows} if total else {}


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", *(F.col(f"cell.{n}").alias(f"cell_{n}") for n in TARGETS), F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "kept")
