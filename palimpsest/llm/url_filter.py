"""URL filters: rules on hosts and paths first, gradient-boosted trees on lexical features for the rest.

Rules become one conditional expression. How often URLs of a suffix are blocked is counted over all labelled rows, by
default those that rules decide; only the trees are trained on the driver from a bounded sample of them. They score all
others where they are read, as expressions over features that are expressions too, joined with the suffixes' table, which
is broadcast where it is small.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.llm.common import computed_once, lower_ascii, stash, table
from palimpsest.llm.trees import Node, boost, total

FEATURES = ("length", "host_length", "host_depth", "path_depth", "path_length", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "host_digits", "top_rate", "site_rate", "host_word", "vowel_ratio")

#: Up to so many suffixes are broadcast.
MOST_BROADCAST = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty where there is no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, like `example.org/en/`, or null. rules: rule to verdict, allow or block; of rules of
    one length the first in order counts."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r), reverse=True)[::-1]:
        own, slash, start = rule.partition("/")
        own = own.lower()
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffixes(url: Column) -> tuple[Column, Column]:
    """The last label of a URL's host, and the last two."""
    host = F.lower(F.when(url.contains("://"), F.regexp_extract(url, "://([^/?#]*)", 1)).otherwise(F.regexp_extract(url, "^([^/?#]*)", 1)))
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def lexical(url: str, top_rate: float, site_rate: float) -> list[float]:
    """FEATURES of a single URL; the rates: how often URLs of its suffixes are blocked."""
    after = url.split("://", 1)[1] if "://" in url else url
    host = re.split(r"[/?#]", after, maxsplit=1)[0].lower()
    path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]
    query = after.partition("#")[0].partition("?")[2]
    n = max(len(url), 1)
    labels = host.split(".")
    digits = lambda x: sum("0" <= c <= "9" for c in x)
    return [
        len(url), len(host), len(labels), sum(bool(x) for x in path.split("/")), len(path), digits(url) / n,
        -sum(k / n * math.log2(k / n) for k in Counter(url).values()), len([x for x in query.split("&") if x]), url.count("-"), float("#" in url), digits(host),
        top_rate, site_rate, max(map(len, labels)), sum(c in "aeiou" for c in host) / max(len(host), 1),
    ]


def feature_columns(url: Column, top_rate: Column, site_rate: Column) -> dict[str, Column]:
    """FEATURES as expressions, by name."""
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    after = F.when(url.contains("://"), F.regexp_extract(url, "(?s)://(.*)$", 1)).otherwise(url)
    host = F.lower(F.regexp_extract(after, "^([^/?#]*)", 1))
    path, query = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(after, "^[^?#]*[?]([^#]*)", 1)
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    of = lambda c: (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(of(c) * F.log2(of(c))))
    values = (
        F.char_length(url).cast("double"), F.char_length(host).cast("double"), count(host, "[.]") + 1, count(path, "[^/]+"), F.char_length(path).cast("double"), count(url, "[0-9]") / n,
        entropy, count(query, "[^&]+"), count(url, "-"), url.contains("#").cast("double"), count(host, "[0-9]"),
        top_rate, site_rate, F.array_max(F.transform(F.split(host, "[.]", -1), F.char_length)).cast("double"), count(host, "[aeiou]") / F.greatest(F.char_length(host), F.lit(1)),
    )
    return dict(zip(FEATURES, values, strict=True))


def log_odds(start: float, trees: list[Node], row: list[float]) -> float:
    return start + sum(t.score(row) for t in trees)


class UrlModel:
    """Boosted trees, and the table (suffix, rate) of all labelled URLs' suffixes; other suffixes have the usual rate."""

    def __init__(self, table: DataFrame, small: bool, usual: float, rows: list[list[float]], blocked: list[int]):
        self.table, self.small, self.usual = table, small, usual
        self.start, self.trees = boost(rows, blocked)

    @cached_property
    def rates(self) -> dict[str, float]:
        """The table on the driver, for single URLs."""
        return {r["suffix"]: r["rate"] for r in self.table.collect()}

    def score(self, url: str | None) -> float:
        """Log odds of being blocked."""
        url = url or ""
        labels = re.split(r"[/?#]", url.split("://", 1)[-1], maxsplit=1)[0].lower().split(".")
        top, site = (self.rates.get(s, self.usual) for s in (labels[-1], ".".join(labels[-2:])))
        return log_odds(self.start, self.trees, lexical(url, top, site))


def with_rates(urls: DataFrame, url: Column, table: DataFrame, usual: float, small: bool) -> DataFrame:
    """urls with _top_rate and _site_rate from the table (suffix, rate); small: counted, and few enough to be broadcast."""
    ship = F.broadcast if small else lambda t: t
    out = urls.withColumns(dict(zip(("_top", "_site"), suffixes(F.coalesce(url, F.lit(""))), strict=True)))
    for name in ("_top", "_site"):
        out = out.join(ship(table.select(F.col("suffix").alias(name), F.col("rate").alias(f"{name}_rate"))), name, "left")
    return out.withColumns({f"{n}_rate": F.coalesce(f"{n}_rate", F.lit(usual)) for n in ("_top", "_site")}).drop("_top", "_site")


def train(urls: DataFrame, url_col: str = "url", label_col: str = "blocked", sample: int = 3000) -> UrlModel:
    """A model from labelled URLs; label 1 is block, 0 allow, others count as none. Suffixes are counted over all rows, before any
    shuffle; the trees are trained on at most `sample` distinct URLs, those with the smallest hashes, blocked if any row of the URL is."""
    u, y, h = F.col(url_col), F.col(label_col).cast("int"), F.xxhash64(F.col(url_col))
    rows = urls.select(u.alias("u"), y.alias("y"), h.alias("h")).where("u is not null and y in (0, 1)")
    top, site = suffixes(F.col("u"))
    sites = stash(rows.groupBy(top.alias("top"), site.alias("site")).agg(F.count("y").alias("n"), F.sum("y").alias("blocked")), "sites")
    n, blocked = sites.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    usual = (blocked + 1) / (n + 2)
    counts = sites.select("n", "blocked", F.explode(F.array_distinct(F.array("top", "site"))).alias("suffix")).groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    # smoothed, and only suffixes of several rows
    table = stash(counts.where("n >= 4").select("suffix", F.round((F.col("blocked") + 4 * usual) / (F.col("n") + 4), 4).alias("rate")), "suffixes")
    # a part of the hashes that is likely to hold enough; where rows repeat much, a larger one
    part = min(1.0, 4 * sample / max(n, 1))
    while True:
        low = rows if part >= 1 else rows.where(F.col("h") < int(part * 2**64) - 2**63)
        chosen = low.groupBy("u", "h").agg(F.max("y").alias("y")).orderBy("h", "u").limit(sample).collect()
        if part >= 1 or len(chosen) == sample:
            break
        part = min(1.0, 8 * part)
    small = table.count() <= MOST_BROADCAST
    rated = with_rates(urls.sparkSession.createDataFrame(chosen, "u string, h long, y int"), F.col("u"), table, usual, small)
    found = rated.select("h", "u", "y", *(c.alias(f) for f, c in feature_columns(F.col("u"), F.col("_top_rate"), F.col("_site_rate")).items())).collect()
    found = sorted(found, key=lambda r: (r["h"], r["u"]))
    return UrlModel(table, small, usual, [[float(r[f]) for f in FEATURES] for r in found], [r["y"] for r in found])


def url_filter(pages: DataFrame, rules: dict[str, str], model: UrlModel | None = None, url_col: str = "url") -> DataFrame:
    """pages and host, path, rule, verdict (string) and score (double, null where a rule decides).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins. No rule: the
    model blocks at log odds over 0. Without a model one is trained on the URLs that rules decide.

    Null URLs or such without `://`: host and path empty, the model judges. Repeated rows: judged alike. Very long URLs:
    read whole. Empty table: empty result. Columns of pages with the names of added ones are replaced; all others stay.
    """
    added = ("host", "path", "rule", "verdict", "score")
    quoted = {c: f"`{c.replace('`', '``')}`" for c in pages.columns if c.lower() not in added or c == url_col}
    host, path = host_and_path(F.col(f"`{url_col}`"))
    out = pages.select(F.struct(*quoted.values()).alias("_row"), F.col(f"`{url_col}`").cast("string").alias("_url"), host.alias("_host"), path.alias("_path"))
    out = out.withColumn("_rule", rule_column(F.col("_host"), F.col("_path"), rules))
    verdicts = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair)) if rules else F.create_map().cast("map<string,string>")
    out = out.withColumn("_verdict", F.when(F.col("_rule").isNotNull(), verdicts[F.col("_rule")]))
    if model is None:
        model = train(out.where("_rule is not null").select("_url", (F.col("_verdict") == "block").cast("int").alias("blocked")), "_url")
    out = with_rates(out, F.col("_url"), model.table, model.usual, model.small)
    scored = computed_once(out, {f"_f_{f}": c for f, c in feature_columns(F.coalesce("_url", F.lit("")), F.col("_top_rate"), F.col("_site_rate")).items()})
    scored = scored.withColumn("_score", F.when(F.col("_rule").isNull(), total(model.trees, [f"_f_{f}" for f in FEATURES], model.start)))
    verdict = F.coalesce("_verdict", F.when(F.col("_score") > 0, "block").otherwise("allow"))
    return scored.select(
        *[F.col("_row").getField(c).alias(c) for c in quoted],
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), F.col("_score").alias("score"),
    )


#: The rules of the query: fixed values.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


__all__ = ["Node", "UrlModel", "host_and_path", "op3_url_filter", "rule_column", "train", "url_filter"]
