"""Tables of the engine: Parquet folders under a root, of which a numbered list in JSON says which ones are the table.

A write adds folders and then the list that follows the one it has read, made in one step that fails where its number is taken. Where
another writer came first, the write is put on top of that writer's list if none of its buckets changed, and done anew or
refused if one did. Readers take the list of the largest number that can be read, so that whatever is cut short, they see the table
before or after a write; a list and its folders stay for an hour after the next one.

Keyed tables are dealt to buckets by the low bits of a hash of their key, and a write of some keys replaces only their buckets. The list is
the directory of buckets: each has a depth of its own, and one that outgrows `most` rows is split alone, by as many bits as it takes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import StringType, StructField, StructType

from palimpsest.operators import memory
from palimpsest.plans.materialize import delete, exists, stash

SCHEMAS = {
    "files": "path string, modified timestamp, length long, sha string, project_id string, session_id string, is_sidechain boolean, parent_session string, agent_type string, description string, offset long, lines long, records long, open_bad boolean, tail string",
    "sessions": "session_id string, project_id string, started_at timestamp, ended_at timestamp, user_count long, assistant_count long, message_count long, cwd string, git_branch string, ai_title string, first_prompt string, is_sidechain boolean, parent_session string, content_hash string, summary string, indexed long",
    "usage": "session_id string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long",
    "chunks": "chunk_id string, session_id string, project_id string, turn_index int, sub_index int, role string, kind string, text string, token_count int, redactions int, started_at timestamp, tool_name string, tool_input string",
    "vectors": "chunk_id string, session_id string, project_id string, started_at timestamp, embedding array<double>",
    "embedding_cache": "hash string, embedding array<double>",
    "tool_lines": "session_id string, uuid string, path string, turn_index int, line_no long, at long, size long",
    "stats": "path string, total_lines long, bad_lines long",
    "topics": "topic_id string, label string, description string, members array<string>, sessions array<string>, projects array<string>, centroid array<double>, size int",
    "edges": "edge_id string, kind string, a string, b string, weight double",
    "topic_names": "topic_id string, label string, description string",
    "hits": "chunk_id string, session_id string, project_id string, source string, hit_at timestamp",
    "promotions": "project_id string, target string, content_hash string, promoted_at timestamp",
    "memories": memory.SCHEMA,
    "metrics": "at timestamp, query string, items int, tokens long",
    "summaries": "input_hash string, session_id string, model string, text string",
}
#: The column by which a table is dealt to buckets; rows are replaced by its values.
KEYS = {
    "files": "path", "sessions": "session_id", "usage": "session_id", "chunks": "session_id", "vectors": "session_id", "tool_lines": "session_id", "stats": "path", "topics": "topic_id", "topic_names": "topic_id", "promotions": "project_id", "memories": "id", "summaries": "input_hash",
}
#: Bits by which a new table's buckets are told apart, and rows beyond which a bucket splits.
DEPTH, MOST_ROWS = 4, 250_000
#: The most bits that a bucket can have, and the most buckets that one splits into at once, in bits.
DEEPEST, STEP = 40, 10
#: Folders of a table that is only added to, beyond which they are written anew as one.
MOST_FOLDERS = 64
#: How long lists and folders stay that newer lists have replaced, or that none names yet.
KEEP_MS = 3_600_000
#: How often a write starts anew because other writers changed its buckets.
ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another writer changed what a write builds on."""


def _leaf(leaf: str) -> tuple[int, int]:
    depth, code = leaf.split(".")
    return int(depth), int(code)


def leaf_of(key: str, leaves: list[str]) -> Column:
    """The bucket of a key: of each depth that occurs, whether the hash's low bits are one of its buckets."""
    depths: dict[int, list[int]] = {}
    for depth, code in map(_leaf, leaves):
        depths.setdefault(depth, []).append(code)
    low = lambda depth: F.xxhash64(key).bitwiseAND(F.lit((1 << depth) - 1).cast("long"))
    return F.coalesce(*(F.when(low(d).isin(codes), F.concat(F.lit(f"{d}."), low(d).cast("string"))) for d, codes in sorted(depths.items())))


def split(leaf: str, sizes: dict[int, int], most: int, deeper: int) -> list[str]:
    """The buckets that a bucket splits into. sizes: rows by the hash's low bits, `deeper` bits more than the bucket's."""
    depth, code = _leaf(leaf)
    out, todo = [], [(depth, code)]
    while todo:
        d, c = todo.pop()
        own = sum(n for x, n in sizes.items() if x & ((1 << d) - 1) == c)
        if own <= most or d == depth + deeper:
            out.append(f"{d}.{c}")
        else:
            todo += [(d + 1, c), (d + 1, c + (1 << d))]
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str, most: int = MOST_ROWS, depth: int = DEPTH):
        self.spark, self.root, self.most, self.depth = spark, root.rstrip("/"), most, depth
        self._schemas: dict[str, StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # lists

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        """Of the lists that are there, the largest first."""
        if not exists(self.spark, self.path(name)):
            return []
        p, fs = self._fs(self.path(name))
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit()), reverse=True)

    def _list(self, name: str, number: int) -> dict | None:
        """A list, or None where it was cut short."""
        p, fs = self._fs(f"{self.path(name)}/v{number}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def newest(self, name: str) -> tuple[int, dict]:
        """The number of the list of the largest number that can be read, and the list: the folders (parts) and about as many rows as each bucket
        has, or of "all". 0 and no folders where the table was never written; OSError where lists are there and none is whole."""
        numbers = self._numbers(name)
        for number in numbers:
            if found := self._list(name, number):
                return number, found
        if numbers:
            raise OSError(f"no list of {self.path(name)} can be read")
        return 0, {"parts": {}, "rows": {}}

    def current(self, name: str) -> dict:
        return self.newest(name)[1]

    def _create(self, name: str, number: int, content: dict) -> bool:
        """Make a list; False where its number is taken."""
        p, fs = self._fs(f"{self.path(name)}/v{number}.json")
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
                return False
            raise
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def _commit(self, name: str, base: int, change: Callable[[dict], dict]) -> None:
        """Make the next list, as what change makes of the newest one: of that of number base, or of another writer's since, which change refuses
        by Conflict where it can't be built on."""
        while True:
            number, known = self.newest(name)
            content = change(known)
            target = max([0, *self._numbers(name)[:1]]) + 1
            if not self._create(name, target, content):
                continue
            # a list that another writer was making meanwhile is below this one: this one is made anew on top of it
            late = [n for n in range(number + 1, target) if self._list(name, n)]
            if not late:
                break
            if self._create(name, target + 1, change(self._list(name, late[-1]))):
                break
        if base or number:
            self._clean(name)

    def _clean(self, name: str) -> None:
        """Remove lists that were replaced an hour ago or more, and folders of that age that no list names that stays."""
        folder, fs = self._fs(self.path(name))
        now, times, parts = self.spark._jvm.java.lang.System.currentTimeMillis(), {}, {}
        for status in fs.listStatus(folder):
            own = status.getPath().getName()
            if own.startswith("part-"):
                parts[own] = status.getModificationTime()
            elif own.startswith("v") and own[1:-5].isdigit():
                times[int(own[1:-5])] = status.getModificationTime()
        order = sorted(times)
        gone = [a for a, b in zip(order, order[1:], strict=False) if now - times[b] >= KEEP_MS]
        lists = [x for n in order if n not in gone and (x := self._list(name, n))]
        live = {part.split("/")[0] for x in lists for own in x["parts"].values() for part in own}
        for own, at in parts.items():
            if own not in live and now - at >= KEEP_MS:
                delete(self.spark, f"{self.path(name)}/{own}")
        for number in gone:
            delete(self.spark, f"{self.path(name)}/v{number}.json")

    # tables

    def _schema(self, name: str) -> StructType:
        if name not in self._schemas:
            self._schemas[name] = StructType.fromDDL(SCHEMAS[name])
        return self._schemas[name]

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in self._schema(name)))

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path(name)}/{x}" for x in folders))

    def read(self, name: str) -> DataFrame:
        """The table; empty where it was never written."""
        return self._load(name, [x for own in self.current(name)["parts"].values() for x in own])

    def version(self, name: str) -> dict:
        """What a later write compares with (base): the table as it is now."""
        return self.current(name)

    def _folder(self, name: str, rows: DataFrame, leaves: list[str] | None) -> dict[str, list[str]]:
        """Write rows to a new folder; the parts that it adds. A bucket's rows are one task's, and at most about `most`."""
        folder = f"part-{uuid.uuid4().hex}"
        if leaves is None:
            rows.write.parquet(f"{self.path(name)}/{folder}")
            return {"all": [folder]}
        rows.withColumn("_bucket", leaf_of(KEYS[name], leaves)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path(name)}/{folder}")
        p, fs = self._fs(f"{self.path(name)}/{folder}")
        own = [s.getPath().getName() for s in fs.listStatus(p)]
        return {leaf: [] for leaf in leaves} | {x.split("=")[1]: [f"{folder}/{x}"] for x in own if x.startswith("_bucket=")}

    def _first(self) -> list[str]:
        return [f"{self.depth}.{code}" for code in range(1 << self.depth)]

    def _counts(self, name: str, rows: DataFrame, leaves: list[str]) -> dict[str, int]:
        """Rows of each bucket that has any; sums of _n where there is one."""
        n = F.sum("_n") if "_n" in rows.columns else F.count("*")
        return {r["b"]: r["n"] for r in rows.groupBy(leaf_of(KEYS[name], leaves).alias("b")).agg(n.alias("n")).collect()}

    def _deal(self, name: str, rows: DataFrame, leaves: list[str], sizes: dict[str, int]) -> tuple[list[str], dict[str, int]]:
        """The buckets to write rows to: leaves (with at most sizes rows each), of which those with too many are split by what they really have; and
        the rows of each."""
        out, known = [x for x in leaves if sizes.get(x, 0) <= self.most], {}
        large = [x for x in leaves if x not in out and _leaf(x)[0] < DEEPEST]
        out += [x for x in leaves if x not in out and x not in large]
        while large:
            # a level that every large bucket's share can be told at
            deeper = min(max((sizes[x] // self.most).bit_length() for x in large) + 2, STEP)
            own = rows.withColumn("_b", leaf_of(KEYS[name], large)).where("_b is not null")
            bits = F.substring_index("_b", ".", 1).cast("int") + deeper
            code = F.xxhash64(KEYS[name]).bitwiseAND(F.expr("shiftleft(1L, _d)") - 1)
            found: dict[str, dict[int, int]] = {x: {} for x in large}
            for r in own.withColumn("_d", bits).groupBy("_b", code.alias("c")).count().collect():
                found[r["_b"]][r["c"]] = r["count"]
            again = []
            for leaf, shares in found.items():
                depth = _leaf(leaf)[0]
                for child in split(leaf, shares, self.most, deeper):
                    d, c = _leaf(child)
                    known[child] = sum(n for x, n in shares.items() if x & ((1 << d) - 1) == c)
                    # one that is too large at the last level may be one key, which no bits part
                    more = known[child] > self.most and d == depth + deeper and d < DEEPEST and known[child] < sum(shares.values())
                    (again if more else out).append(child)
            large, sizes = again, sizes | known
        return out, {x: known.get(x, sizes.get(x, 0)) for x in out}

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table; Conflict where another writer changed it meanwhile."""
        base, known = self.newest(name)
        rows = self._shaped(name, df)
        if name in KEYS:
            rows = stash(rows, "to-write")
            leaves, sizes = self._deal(name, rows, self._first(), self._counts(name, rows, self._first()))
            content = {"parts": self._folder(name, rows, leaves), "rows": sizes}
        else:
            content = {"parts": self._folder(name, rows, None), "rows": {}}

        def change(now: dict) -> dict:
            if now["parts"] != known["parts"]:
                raise Conflict(f"{name} was changed by another writer")
            return content

        self._commit(name, base, change)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table without keys, whoever else does."""
        base, known = self.newest(name)
        new = self._folder(name, self._shaped(name, df), None)["all"]
        before = known["parts"].get("all", [])
        whole = self._folder(name, self._load(name, before + new), None)["all"] if len(before) + len(new) > MOST_FOLDERS else None

        def change(now: dict) -> dict:
            own = now["parts"].get("all", [])
            if whole and own[: len(before)] == before:
                return {"parts": {"all": whole + own[len(before) :]}, "rows": {}}
            return {"parts": {"all": own + new}, "rows": {}}

        self._commit(name, base, change)

    def replace(self, name: str, rows: DataFrame, gone: DataFrame | None = None, base: dict | None = None) -> None:
        """Put rows in the place of all rows of their keys; of those of the keys in gone (a column of that name) where it is given,
        which then has all keys of rows. Only these keys' buckets are read and written. Where another writer changes one of them meanwhile, it is
        done anew on top of that; with base, the version that rows were made from, Conflict is raised where one of them changed since."""
        key = KEYS[name]
        rows = self._shaped(name, rows)
        keys = (rows if gone is None else gone).select(key).distinct()
        for left in range(ATTEMPTS - 1, -1, -1):
            number, known = self.newest(name)
            leaves = list(known["parts"]) or self._first()
            # rows of each bucket that a key is in, in one pass
            sizes = self._counts(name, keys.withColumn("_n", F.lit(0)).unionByName(rows.select(key).withColumn("_n", F.lit(1))), leaves)
            touched = sorted(sizes)
            if not touched:
                return
            here = {x: known["parts"].get(x, []) for x in touched}
            if base is not None and any(base["parts"].get(x, []) != own for x, own in here.items()):
                raise Conflict(f"{name} was changed by another writer")
            old = [x for own in here.values() for x in own]
            sizes = {x: n + known["rows"].get(x, 0) for x, n in sizes.items()}
            merged = self._load(name, old).join(keys, key, "left_anti").unionByName(rows) if old else rows
            own, sizes = self._deal(name, merged, touched, sizes)
            new = self._folder(name, merged, own)
            first = {} if known["parts"] else {x: [] for x in leaves}

            def change(now: dict, here=here, new=new, sizes=sizes, first=first) -> dict:
                if any(now["parts"].get(x, []) != parts for x, parts in here.items()) or (now["parts"] and any(x not in now["parts"] for x in here)):
                    raise Conflict(f"{name} was changed by another writer")
                kept = {x: parts for x, parts in (now["parts"] or first).items() if x not in here}
                return {"parts": kept | new, "rows": {x: n for x, n in now["rows"].items() if x not in here} | sizes}

            try:
                return self._commit(name, number, change)
            except Conflict:
                if base is not None or not left:
                    raise

    def remove(self, name: str, gone: DataFrame) -> None:
        """Drop the rows whose key is in gone."""
        self.replace(name, self.spark.createDataFrame([], SCHEMAS[name]), gone)

    def export_json(self, name: str, path: str) -> None:
        """Write a table as lines of JSON, for others to read."""
        self.read(name).write.json(path)

    def import_json(self, name: str, path: str) -> int:
        """Put rows of JSON lines in the place of those of their keys, or add them to a table without keys; how many lines could not be
        used, as they aren't JSON or have no key."""
        key = KEYS.get(name)
        rows = self.spark.read.schema(StructType([*self._schema(name).fields, StructField("_bad", StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path)
        rows = stash(rows, "imported")
        good = F.col("_bad").isNull() & (F.col(key).isNotNull() if key else F.lit(True))
        (self.replace if key else self.append)(name, rows.where(good).drop("_bad"))
        return rows.where(~good).count()

    def dimension(self) -> int | None:
        """Components of the stored vectors; None without any."""
        row = self.read("vectors").select(F.size("embedding").alias("n")).first()
        return row["n"] if row else None
