"""Small tree learners for bounded samples: regression trees on binned features, boosted or in a forest.

They run on the driver over plain numbers and come out as nested tests on thresholds, which score rows as numpy
arrays or as Spark conditional expressions.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def total(trees: list[Node], features: list[str], start: float = 0.0) -> Column:
    """The sum of start and all trees, in their order."""
    return F.expr(" + ".join([f"{start!r}D", *(t.sql(features) for t in trees)]))


@dataclass(frozen=True)
class Node:
    """A test `feature <= cut`, or a value where feature is negative."""

    feature: int
    cut: float
    low: Node | None
    high: Node | None
    value: float

    def sql(self, features: list[str]) -> str:
        """The tree over columns of these names, as an expression in SQL: a tree is one call to the JVM, whatever its size."""
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"CASE WHEN `{features[self.feature]}` <= {self.cut!r}D THEN {self.low.sql(features)} ELSE {self.high.sql(features)} END"

    def score(self, row) -> float:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value


def cuts(values: list[float], most: int = 32) -> list[float]:
    """Thresholds between neighbouring values, at most so many and evenly spread."""
    known = sorted(set(values))
    middle = [(a + b) / 2 for a, b in zip(known, known[1:], strict=False)]
    step = max(1, math.ceil(len(middle) / most))
    return middle[step // 2 :: step] if middle else []


class Binned:
    """Rows of features, each as the number of its bin."""

    def __init__(self, rows: list[list[float]]):
        self.n = len(rows)
        self.cuts = [cuts([r[f] for r in rows]) for f in range(len(rows[0]) if rows else 0)]
        self.bins = []
        for f, own in enumerate(self.cuts):
            place = {v: sum(c < v for c in own) for v in {r[f] for r in rows}}
            self.bins.append([place[r[f]] for r in rows])

    def tree(self, own: list[int], target: list[float], weight: list[float], depth: int, least: int, features: list[int] | None, rng: random.Random, tried: int, leaf) -> Node:
        """The tree that takes most from the weighted squared error of target, over the rows in own. tried: features that a
        node chooses from, at random; leaf: the value of a list of rows."""
        total, weights = sum(target[i] * weight[i] for i in own), sum(weight[i] for i in own)
        best = (1e-9, -1, 0)
        if depth and len(own) >= 2 * least:
            for f in rng.sample(features, min(tried, len(features))) if tried < len(features) else features:
                k = len(self.cuts[f])
                if not k:
                    continue
                sums, masses, counts, bins = [0.0] * (k + 1), [0.0] * (k + 1), [0] * (k + 1), self.bins[f]
                for i in own:
                    b = bins[i]
                    sums[b] += target[i] * weight[i]
                    masses[b] += weight[i]
                    counts[b] += 1
                s = m = 0.0
                c = 0
                for b in range(k):
                    s, m, c = s + sums[b], m + masses[b], c + counts[b]
                    if c >= least and len(own) - c >= least and 0 < m < weights:
                        gain = s * s / m + (total - s) ** 2 / (weights - m) - total * total / weights
                        if gain > best[0] + 1e-12:
                            best = (gain, f, b)
        if best[1] < 0:
            return Node(-1, 0.0, None, None, leaf(own))
        f, b = best[1:]
        low, high = [i for i in own if self.bins[f][i] <= b], [i for i in own if self.bins[f][i] > b]
        more = (target, weight, depth - 1, least, features, rng, tried, leaf)
        return Node(f, self.cuts[f][b], self.tree(low, *more), self.tree(high, *more), 0.0)


def boost(rows: list[list[float]], labels: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, seed: int = 1) -> tuple[float, list[Node]]:
    """Gradient-boosted trees for the log odds of label 1: the start and the trees, whose values add up."""
    n = len(rows)
    share = min(max(sum(labels) / n, 1e-3), 1 - 1e-3) if n else 0.5
    start = math.log(share / (1 - share))
    if not n or len(set(labels)) < 2:
        return (start if n else 0.0), []
    data, rng, score, trees = Binned(rows), random.Random(seed), [start] * n, []
    features = list(range(len(rows[0])))
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        gradient, weight = [y - q for y, q in zip(labels, p, strict=True)], [max(q * (1 - q), 1e-4) for q in p]
        step = [g / w for g, w in zip(gradient, weight, strict=True)]

        def leaf(own, gradient=gradient, weight=weight):
            return round(rate * sum(gradient[i] for i in own) / (sum(weight[i] for i in own) + 1), 6)

        tree = data.tree(list(range(n)), step, weight, depth, least, features, rng, len(features), leaf)
        if tree.feature < 0:
            break
        trees.append(tree)
        score = [s + tree.score(r) for s, r in zip(score, rows, strict=True)]
    return start, trees


def forest(rows: list[list[float]], labels: list[int], trees: int = 15, depth: int = 6, least: int = 3, seed: int = 1) -> list[Node]:
    """A random forest; the mean of its trees' values is the share of label 1."""
    n = len(rows)
    if not n:
        return []
    data, rng, out = Binned(rows), random.Random(seed), []
    features = list(range(len(rows[0])))
    target, weight = [float(y) for y in labels], [1.0] * n
    for _ in range(trees):
        own = rng.choices(range(n), k=n)
        out.append(data.tree(own, target, weight, depth, least, features, rng, max(1, math.ceil(math.sqrt(len(features))) + 1), lambda x: round(sum(labels[i] for i in x) / len(x), 6)))
    return out
