"""Secret scans: candidate strings and a random forest that sorts out false positives.

Candidates are long runs of the characters that secrets consist of, found with built-in functions among
the words of each text, values that are quoted or assigned after a cue, and what starts with a known prefix. Features are expressions over a candidate and its neighbouring words; the forest, trained
on the driver from labelled findings, is a sum of conditional expressions. Only candidates are exploded.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from palimpsest.llm.common import SPACE, SPACE_CHARS, Stash, table
from palimpsest.llm.trees import Node, forest, total

#: Unbroken runs are candidates from this length on, by default.
SHORTEST = 16
#: Words that stand before secrets, and before other long strings.
CUES = "token|secret|passwd|password|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key"
OTHER_CUES = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|etag|revision|integrity|path|file|url|href"
#: Values after a cue, and what known prefixes start, from this length on.
SHORTEST_VALUE = 8
_KEY = f"(?i:{CUES.replace('auth', 'auth(?!or)').replace('secret', 'secret(?!ar)')})[A-Za-z0-9_-]{{0,32}}(?:\\\\?[\"'`])?"
_ASSIGN = "(?:(?:\\s*:\\s*[A-Za-z_]{1,32})?\\s*(?::=|=>|[:=])\\s*|\\s+(?=\\\\?[\"'`]))"
_HEAD = f"{_KEY}{_ASSIGN}(?:\\\\?[\"'`])?"
#: Between quotes anything but these and line ends; without them, up to white space or a quote.
_QUOTED = "|".join(f"(?<=[{a}])[^{b}\\r\\n]{{{SHORTEST_VALUE - 1},}}[^{b}\\r\\n\\\\](?=\\\\?[{a}])" for a, b in (('"', '"'), ("'", "'"), ("`", "`"), ("\"'`", "\"'`")))
_BARE = f"[^\\s\"'`]{{{SHORTEST_VALUE - 1},}}[^\\s\"'`,;#)\\]}}]"
_PREFIXED = f"(?<![A-Za-z0-9])(?:sk-|[sr]k_live_|gh[pousr]_|github_pat_|AKIA|ASIA|AIza|xox[a-z]-|eyJ)[A-Za-z0-9+/_=.-]{{{SHORTEST_VALUE},}}"
#: Groups: what stands before a value, the value, or a prefixed string.
_VALUE = f"({_HEAD})({_QUOTED}|{_BARE})|({_PREFIXED})"
_MARK = "\ue000"
#: The share of all words from which on a word is in the dictionary.
FREQUENT = 1 / 5000
FEATURES = ("length", "transitions", "digit_ratio", "upper_ratio", "hex", "dictionary", "slashes", "dots", "extension", "cue", "other_cue", "assigned", "quoted", "distinct", "spaces", "symbols", "placeholder")


def run_pattern(shortest: int) -> str:
    return f"[A-Za-z0-9+/_=.-]{{{shortest},}}"


def candidates(docs: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST) -> DataFrame:
    """(id_col, pos, finding, word, before, after): each candidate and its neighbours; pos: its word, from 0, or the first
    of its words. shortest: of unbroken runs; values after a cue and prefixed strings count from SHORTEST_VALUE on."""
    run = run_pattern(shortest)
    trimmed = F.trim(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(SPACE_CHARS))
    words = docs.select(F.col(f"`{id_col}`").alias("_id"), F.split(trimmed, f"{SPACE}+", -1).alias("_words"))
    at = lambda i: F.coalesce(F.get("_words", i), F.lit(""))
    long = F.transform(F.col("_words"), lambda w, i: F.when(F.octet_length(w) >= shortest, F.when(w.rlike(run), i)))
    # twice used, so that the words stay computed
    found = words.select("_id", "_words", F.explode(F.array_compact(long)).alias("_pos"))
    near = found.select(
        "_id", F.col("_pos").cast("long").alias("pos"), at(F.col("_pos")).alias("word"),
        F.concat_ws(" ", at(F.col("_pos") - 3), at(F.col("_pos") - 2), at(F.col("_pos") - 1)).alias("before"), at(F.col("_pos") + 1).alias("after"),
    )
    out = near.select("_id", "pos", "word", "before", "after", F.explode(F.regexp_extract_all("word", F.lit(run), 0)).alias("finding"))
    return out.unionByName(_values(docs, id_col, trimmed, run)).withColumnRenamed("_id", id_col)


def _values(docs: DataFrame, id_col: str, trimmed: Column, run: str) -> DataFrame:
    """Candidates that are values after a cue or have a known prefix, but for those that are long runs as a whole."""
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), trimmed.alias("_text")).where(F.col("_text").rlike(_VALUE))
    # a mark before each value, so that the words of the marked text tell where they are
    marked = F.regexp_replace(F.translate("_text", _MARK, "\ufffd"), _VALUE, f"$1{_MARK}$2$3")
    places = F.flatten(F.transform(F.split(marked, f"{SPACE}+", -1), lambda w, i: F.array_repeat(i, F.regexp_count(w, F.lit(_MARK)))))
    parts = (F.regexp_extract_all("_text", F.lit(_VALUE), k) for k in (0, 1))
    zipped = F.arrays_zip(places.alias("pos"), *(c.alias(n) for n, c in zip(("all", "head"), parts, strict=True)))
    found = texts.select("_id", F.split("_text", f"{SPACE}+", -1).alias("_words"), F.explode(zipped).alias("_v"))
    found = found.select("_id", "_words", F.col("_v")["pos"].alias("_pos"), F.col("_v")["all"].alias("_all"), F.col("_v")["head"].alias("_head"), F.expr("substring(_v.all, char_length(_v.head) + 1)").alias("finding"))
    at = lambda i: F.coalesce(F.get("_words", i), F.lit(""))
    return found.where(~F.col("finding").rlike(f"^{run}$")).select(
        "_id", F.col("_pos").cast("long").alias("pos"), F.when(F.col("_head") != "", F.col("_all")).otherwise(at(F.col("_pos"))).alias("word"),
        F.concat_ws(" ", at(F.col("_pos") - 3), at(F.col("_pos") - 2), at(F.col("_pos") - 1)).alias("before"),
        at(F.col("_pos") + F.regexp_count("finding", F.lit(f"{SPACE}+")) + 1).alias("after"), "finding",
    )


def features(dictionary: tuple[str, ...]) -> dict[str, Column]:
    """FEATURES as expressions over a candidate's columns."""
    c, n = F.col("finding"), F.char_length("finding").cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    known = F.lit(0.0)
    if dictionary:
        known = (n - F.char_length(F.regexp_replace(F.lower(c), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), ""))) / n
    before = F.lower("before")
    head = F.lower(F.expr("substring_index(word, finding, 1)"))  # of the word, up to the candidate
    return {
        "length": n, "transitions": count("(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / n, "digit_ratio": count("[0-9]") / n, "upper_ratio": count("[A-Z]") / n,
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "dictionary": known, "slashes": count("/"), "dots": count("[.]"), "extension": c.rlike("[.][a-z]{1,4}$").cast("double"),
        "cue": (before.rlike(CUES) | head.rlike(CUES) | F.lower(c).rlike(f"({CUES})[=_-]")).cast("double"), "other_cue": (before.rlike(OTHER_CUES) | head.rlike(OTHER_CUES)).cast("double"),
        "assigned": (F.col("before").rlike("[=:]$") | F.col("word").rlike("[=:]")).cast("double"), "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "spaces": count(SPACE) / n, "symbols": count("[^A-Za-z0-9\\s]") / n,
        "placeholder": c.rlike("^(<.*>|[$]?[{].*[}]|[$][A-Za-z_]+|%.*|\\[.*\\]|[A-Za-z_.]+[(\\[].*)$").cast("double"),
    }


@dataclass(frozen=True)
class SecretModel:
    dictionary: tuple[str, ...]
    trees: tuple[Node, ...]

    def column(self) -> Column:
        """The forest's share for secret, over columns named as FEATURES with an underscore before."""
        return total(list(self.trees), [f"_{f}" for f in FEATURES]) / max(len(self.trees), 1)


def with_features(found: DataFrame, dictionary: tuple[str, ...]) -> DataFrame:
    return found.select("*", *(x.alias(f"_{f}") for f, x in features(dictionary).items()))


def frequent_words(docs: DataFrame, text_col: str = "text", least: float = FREQUENT) -> tuple[str, ...]:
    """The words of 3 to 8 letters a-z that are at least the share `least` of all such words of all documents, most frequent
    first; by that share there are no more than 1 / least."""
    text = F.lower(F.col(f"`{text_col}`").cast("string"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit("(?<![a-z])[a-z]{3,8}(?![a-z])"), 0)).alias("w"))
    counts = Stash(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.df.agg(F.sum("n")).first()[0] or 0
    out = tuple(r["w"] for r in counts.df.where(F.col("n") >= least * total).orderBy(F.desc("n"), "w").collect())
    counts.drop()
    return out


def example_findings(dictionary: tuple[str, ...], n: int = 700, seed: int = 4) -> list[tuple[str, int]]:
    """Labelled texts, each with one candidate: made secrets in the places where secrets stand, and the usual false
    positives. They stand in for a table of reviewed findings where there is none."""
    rng = random.Random(seed)
    words = list(dictionary) or ["the", "and", "with", "this", "that", "from", "have", "tion", "ment"]
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda k: " ".join(rng.choices(words, k=k))
    letters = lambda k: "".join(rng.choices(words, k=k))
    random_of = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    cue = lambda: rng.choice(["token", "secret", "password", "api_key", "API_KEY", "access_key", "auth", "TOKEN", "private_key", "credential"])
    other = lambda: rng.choice(["commit", "sha256", "md5", "hash", "checksum", "uuid", "etag", "revision", "digest"])
    beside = lambda: rng.choice([
        random_of("0123456789", 16, 24), f"{letters(2)[:8]}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", f"mail{rng.randint(1, 9)}.{letters(2)}.example.com", f"{letters(5).upper():E<16}!!", f"{letters(5):e<16}", "/".join(rng.choices(words, k=5)) + "/index.html",
    ])
    out = []
    for k in range(n):
        secret = rng.choice([lambda: random_of(hexa, 32, 64), lambda: random_of(hexa, 32, 64).upper(), lambda: random_of(mixed, 20, 60), lambda: random_of(mixed + "+/", 24, 64), lambda: rng.choice(["ghp_", "sk_live_", "AKIA", "xoxb-"]) + random_of(mixed, 20, 40)])()
        if k % 2:
            quote = rng.choice(['"', "'", ""])
            text = rng.choice([f"{cue()} = {quote}{secret}{quote}", f"{cue()}={quote}{secret}{quote}", f"{cue()}: {quote}{secret}{quote}", f"Bearer {secret}", f'"{cue()}": "{secret}"'])
            out.append((f"{some(3)} {text}{rng.choice(['', ',', '###', '.'])} {some(2)}", 1))
        else:
            text = rng.choice([
                lambda: f"{other()} {random_of(hexa, 32, 64)}", lambda: f"{other()}: {random_of(hexa, 32, 64)}", lambda: letters(7)[: rng.randint(18, 40)].ljust(SHORTEST, "e"),
                lambda: "/".join(rng.choices(words, k=5)) + rng.choice([".py", ".html", ".md", ""]) + "/index", lambda: random_of("0123456789", 16, 24), lambda: rng.choice("-=._") * rng.randint(16, 60),
                lambda: f"mail{rng.randint(1, 9)}.{letters(3)}.example.com", lambda: letters(6).upper() + "!!", lambda: f"{cue()} {letters(6)}", lambda: f"{letters(3)}-{letters(3)}-{letters(3)}",
                lambda: f"{rng.randint(2000, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}.{rng.randint(0, 59):02}.00", lambda: f"uuid {'-'.join(random_of(hexa, m, m) for m in (8, 4, 4, 4, 12))}",
                # what stands after another's value
                lambda: f'{cue()} = "{letters(1)[:6]}"{rng.choice(["", "###", ","])} {beside()}', lambda: f'{cue()}: "{letters(1)[:6]}" {some(1)} {beside()}',
            ])()
            out.append((f"{some(3)} {text} {some(2)}", 0))
    return out


def example_values(dictionary: tuple[str, ...], n: int = 700, seed: int = 6) -> list[tuple[str, int]]:
    """Labelled texts as example_findings, of short values and such with other characters: passwords after cues and short
    prefixed tokens, and the prose, placeholders, code and paths that stand in their places."""
    rng = random.Random(seed)
    words = list(dictionary) or ["the", "and", "with", "this", "that", "from", "have", "tion", "ment"]
    digits, symbols = "0123456789", "!@$%^&*?~"
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + digits
    some = lambda k: " ".join(rng.choices(words, k=k))
    random_of = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    word = lambda: rng.choice([rng.choice(words), "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))])
    name = lambda: "_".join(rng.choices(words, k=2))
    cue = lambda: rng.choice(["token", "secret", "password", "api_key", "API_KEY", "passwd", "auth", "DB_PASSWORD", "private_key", "client_secret"])
    secrets = [
        lambda: f"{word()}{random_of(digits, 1, 4)}{word()}".ljust(8, "7"), lambda: random_of(mixed, 8, 15), lambda: random_of("0123456789abcdef", 8, 15), lambda: f"{word()}{random_of(symbols, 1, 2)}{word()}{random_of(digits, 1, 4)}".ljust(8, "!"),
        lambda: f"{word().title()}{random_of(digits, 2, 4)}{random_of(symbols, 1, 3)}".ljust(8, "!"), lambda: random_of(mixed + 3 * symbols, 8, 24), lambda: f"{random_of(mixed, 4, 8)} {random_of(mixed + symbols, 4, 8)}",
    ]
    others = [
        lambda: some(rng.randint(3, 6)), lambda: f"{some(3).capitalize()}, {some(2)}.", lambda: (word() + rng.choice(words) + rng.choice(words)).ljust(8, "e"), lambda: f"<your-{rng.choice(words)}>", lambda: f"<{name()} {rng.choice(words)}>",
        lambda: f"${{{name().upper()}}}", lambda: f"${name().upper()}_ID", lambda: f"{{{{ {name()} }}}}", lambda: rng.choice("*x.-") * rng.randint(8, 15), lambda: f"get_{name()}()", lambda: f"os.environ[{name()}]", lambda: f"config.{name()}",
        lambda: f"/{'/'.join(rng.choices(words, k=3))}.txt", lambda: f"{rng.randint(2000, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"%({name()})s", lambda: f"[{some(3)}]",
    ]
    starts = ["ghp_", "sk-", "AKIA", "xoxb-", "xoxp-", "ASIA"]
    out = []
    for k in range(n):
        quote = rng.choice(['"', "'"])
        if k % 8 < 2:
            start = rng.choice(starts)
            value = start + (random_of(mixed, 10 if k % 2 else 8, 15 - len(start)) if k % 2 else f"{rng.choice(words)}-{rng.choice(words)}-{rng.choice(words)}")
            text = rng.choice([value, f"{quote}{value}{quote}", f"({value})", f"use {value}"])
        else:
            value = rng.choice(secrets if k % 2 else others)()
            forms = [f"{cue()} = {quote}{value}{quote}", f"{cue()}={quote}{value}{quote}", f"{cue()}: {quote}{value}{quote}", f'"{cue()}": "{value}"']
            text = rng.choice(forms if " " in value else [*forms, f"{cue()}={value}", f"{cue()}: {value}"])
        out.append((f"{some(3)} {text} {some(2)}", k % 2))
    return out


def train(findings: DataFrame, dictionary: tuple[str, ...] = (), text_col: str = "text", label_col: str = "label", sample: int = 2000) -> SecretModel:
    """A forest from at most `sample` labelled findings: texts around one secret or other candidate, label 1 a secret, 0 none."""
    rows = findings.where(F.col(label_col).isin(0, 1)).orderBy(F.xxhash64(text_col), text_col).limit(sample).select(F.struct(F.xxhash64(text_col).alias("h"), F.col(label_col).cast("int").alias("y")).alias("_key"), text_col)
    found = with_features(candidates(rows, "_key", text_col), dictionary).select("_key", "pos", *(f"_{f}" for f in FEATURES))
    found = sorted(found.collect(), key=lambda r: (r["_key"]["h"], r["pos"]))
    return SecretModel(tuple(dictionary), tuple(forest([[float(r[f"_{f}"]) for f in FEATURES] for r in found], [r["_key"]["y"] for r in found], trees=11, depth=5)))


def secret_scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, shortest: int = SHORTEST) -> DataFrame:
    """A row for each candidate: id_col, pos (long, its word from 0), finding, before, after (string), score (double) and
    is_secret (boolean). Candidates are unbroken runs of `shortest` (16) or more of letters, digits and +/_=.-, and from 8
    characters on values that are quoted or assigned after a cue, and what starts with a known prefix.

    Null or empty text: no candidates. Null ids and repeated rows: findings of each row. Very long texts: read whole. Empty
    table: empty result. Other columns of docs are not read.
    """
    found = with_features(candidates(docs, id_col, text_col, shortest), model.dictionary)
    out = found.select(f"`{id_col}`", "pos", "finding", "before", "after", F.round(model.column(), 6).alias("score"))
    return out.withColumn("is_secret", F.col("score") >= least)


def redact(text: Column, findings: Column) -> Column:
    """text with each of an array of findings replaced by a mark."""
    return F.aggregate(findings, text, lambda t, f: F.replace(t, f, F.lit("[SECRET]")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dictionary = frequent_words(docs)
    examples = example_findings(dictionary) + example_values(dictionary)
    model = train(spark.createDataFrame(examples, "text string, label int"), dictionary)
    out = secret_scan(docs, model)
    return out.select("doc_id", "pos", F.char_length("finding").cast("long").alias("n_chars"), F.sha2("finding", 256).alias("finding_sha256"), "score", "is_secret")
