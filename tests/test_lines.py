"""Lines by bytes, and indexes that go on where files have grown."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import lines as ln
from palimpsest.sources import transcripts as tr
from palimpsest.sources.store import Store
from palimpsest.streaming import indexer


def record(ty, at, content, **more):
    return json.dumps({"type": ty, "uuid": f"{ty}-{at}", "timestamp": f"2025-01-01T{at // 60:02}:{at % 60:02}:00Z", "message": {"role": ty, "content": content, **more.pop("message", {})}, **more}, ensure_ascii=False).encode()


def messy(seed, n):
    rng = random.Random(seed)
    kinds = (lambda k: record("user", k, f"prompt {k} é"), lambda k: b'{"type": "user", "x": "\xff\xfe"}', lambda k: b"", lambda k: b"  ", lambda k: record("user", k, "cut")[: rng.randint(1, 30)], lambda k: b"\xc3", lambda k: record("assistant", k, "long " * 900), lambda k: b"1\r")
    return b"\n".join(rng.choice(kinds)(k) for k in range(n))


def plain(content):
    """(line_no, offset, line, whether it is valid) of the lines that aren't empty."""
    out, at = [], 0
    for no, x in enumerate(content.split(b"\n")):
        if x:
            try:
                json.loads(x.decode())
                good = True
            except ValueError:
                good = False
            out.append((no, at, x, good))
        at += len(x) + 1
    return out


@pytest.mark.parametrize("size", [1, 7, 300, 1 << 20])
def test_ranges_against_a_plain_reader(spark, tmp_path, monkeypatch, size):
    """Files of several ranges keep their line numbers and offsets; every byte is one range's."""
    os.makedirs(tmp_path / "p q")
    contents = [messy(1, 60 if size < 10 else 400), messy(2, 30) + b"\n", b"", b"\n\n\n", b"x", record("user", 1, "y" * 5000)]
    files = []
    for k, c in enumerate(contents):
        (tmp_path / "p q" / f"{k}.jsonl").write_bytes(c)
        files.append((f"file:{tmp_path}/p q/{k}.jsonl", f"s{k}", "p", len(c)))
    rows = spark.createDataFrame(files, "path string, session_id string, project_id string, length long")
    scanned = tr.scan(rows, size)
    scanned.write.parquet(str(tmp_path / "scanned"))
    scanned = spark.read.parquet(str(tmp_path / "scanned"))
    got = {}
    for r in ln.numbered(scanned).collect():
        got.setdefault(r["path"], []).append((r["line_no"], r["at"], bytes(r["line"])))
    parsed = tr.parse(scanned, rows)
    good = {(r["path"], r["line_no"]) for r in parsed.where("v is not null").select("path", "line_no").collect()}
    stats = {r["path"]: (r["total_lines"], r["bad_lines"]) for r in tr.parse_stats(parsed).collect()}
    sizes = {r["path"]: (r["n"], r["b"]) for r in scanned.groupBy("path").agg(F.sum("lines").alias("n"), F.sum("bytes").alias("b")).collect()}
    for (path, *_), c in zip(files, contents, strict=True):
        want = plain(c)
        assert sorted(got.get(path, [])) == [x[:3] for x in want]
        assert {no for p, no in good if p == path} == {x[0] for x in want if x[3]}
        assert stats.get(path, (0, 0)) == (len(want), sum(not x[3] for x in want))
        assert sizes.get(path, (0, 0)) == (c.count(b"\n"), len(c))
    turns = {(r["path"], r["line_no"]): r["turn_index"] for r in tr.records(parsed).select("path", "line_no", "turn_index").collect()}
    for (path, *_), c in zip(files, contents, strict=True):
        assert [turns[path, x[0]] for x in plain(c) if x[3]] == list(range(sum(x[3] for x in plain(c))))


def test_long_lines_are_read_in_growing_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(ln, "CHUNK", 8)
    content = b"ab\n" + b"x" * 5000 + b"\n\nlast"
    (tmp_path / "f").write_bytes(content)
    for first in range(0, 5012, 97):
        with ln.opened(f"file:{tmp_path}/f") as f:
            got = list(ln.lines_of(f, 0, first, first + 97, len(content)))
        assert got == [(at, x, at + len(x) < len(content)) for at, x in ((0, b"ab"), (3, b"x" * 5000), (5004, b""), (5005, b"last")) if first <= at < first + 97]


def test_what_only_spark_opens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ln, "OPENED", ("none",))
    c = messy(3, 50)
    (tmp_path / "f.jsonl").write_bytes(c)
    rows = spark.createDataFrame([(f"file:{tmp_path}/f.jsonl", "s", "p", len(c))], "path string, session_id string, project_id string, length long")
    assert [(r["line_no"], bytes(r["line"])) for r in sorted(ln.numbered(tr.scan(rows).cache()).collect())] == [(x[0], x[2]) for x in plain(c)]
    assert ln.hashes(rows).first()["sha"] == __import__("hashlib").sha256(c).hexdigest()


def folder(tmp_path):
    d = tmp_path / "in" / "-proj"
    (d / "main" / "subagents").mkdir(parents=True)
    return d


def table(store, name, *without):
    df = store.read(name)
    return sorted((tuple(r) for r in df.drop("started_at", "content_hash", "sha", "summary", *without).collect()), key=str)


def test_bad_bytes_cost_only_their_lines(spark, tmp_path):
    """A bad file, a bad sidecar and a file that can't be opened leave all others alone."""
    d = folder(tmp_path)
    (d / "good.jsonl").write_bytes(record("user", 1, "a good prompt"))
    (d / "bad.jsonl").write_bytes(b"\xff\n" + record("user", 2, "after a bad byte") + b'\n{"type": "user", "message": {"role": "user", "content": "\xe9"}}\n')
    for name, meta in (("one", b'{"agentType": "\xff"}'), ("two", b'{"agentType": "Explore"}')):
        (d / "main" / "subagents" / f"agent-{name}.jsonl").write_bytes(record("user", 3, f"side {name}"))
        (d / "main" / "subagents" / f"agent-{name}.meta.json").write_bytes(meta)
    store = Store(spark, str(tmp_path / "store"))
    out = indexer.refresh(store, str(tmp_path / "in"))
    assert out["files"] == 4 and "failed" not in out
    assert {r["text"] for r in store.read("chunks").collect()} == {"a good prompt", "after a bad byte", "side one", "side two"}
    assert {os.path.basename(r["path"]): (r["total_lines"], r["bad_lines"]) for r in store.read("stats").collect()}["bad.jsonl"] == (3, 2)
    assert {r["session_id"]: (r["is_sidechain"], r["agent_type"]) for r in store.read("files").where("session_id in ('one', 'two')").collect()} == {"one": (False, None), "two": (True, "Explore")}
    gone = store.read("files").where("session_id = 'good'").withColumn("path", F.lit(f"file:{tmp_path}/none.jsonl"))
    assert indexer.index(store, gone.unionByName(store.read("files").where("session_id = 'two'")).select("path", "modified", "length", "sha", "project_id", "session_id", "is_sidechain", "parent_session", "agent_type", "description")) == {"files": 1, "chunks": 1, "hits": 1, "misses": 0, "bytes": len(record("user", 3, "side two")), "failed": 1}


def test_grown_files_are_read_from_where_they_ended(spark, tmp_path, monkeypatch):
    """What is read equals what was appended, and rows those of a full index: with turns, calls whose results come later, lines that were not
    ended, and ones cut in the middle."""
    d = folder(tmp_path)
    monkeypatch.setattr(ln, "RANGE", 400)
    call = lambda at, *names: record("assistant", at, [{"type": "text", "text": f"doing {at}"}, *({"type": "tool_use", "id": n, "name": n, "input": {"q": at}} for n in names)], message={"model": "m", "usage": {"input_tokens": at, "output_tokens": 1}})
    result = lambda at, of, text: json.dumps({"type": "attachment", "uuid": f"r{at}", "parentUuid": f"assistant-{of}", "attachment": {"type": "tool-result", "result": text}}).encode()
    cut = record("user", 9, "written in two steps")
    steps = [
        b"\n".join([record("user", 1, "first prompt", cwd="/a"), call(2, "Read", "Write"), result(3, 2, "of Read"), b"\xff bad", b"", b'{"type": "ai-title", "aiTitle": "one"}']),  # its last line isn't ended
        b"\n" + result(4, 2, "of Write, later") + b"\n" + record("user", 5, "second") + b"\n" + call(6, "Bash") + b"\n" + cut[:20],
        cut[20:] + b"\n" + call(10, "Late") + b"\n" + result(11, 6, "long after") + b"\n" + result(12, 10, "at once") + b'\n{"type": "user"}\n' + record("user", 14, "the end", cwd="/b"),
    ]
    (d / "other.jsonl").write_bytes(record("user", 1, "not touched"))
    store, content, reread = Store(spark, str(tmp_path / "store")), b"", [0, 0, 20]
    for k, step in enumerate(steps):
        content += step
        with open(d / "grows.jsonl", "ab") as f:
            f.write(step)
        out = indexer.refresh(store, str(tmp_path / "in"))
        assert out["files"] == (2 if k == 0 else 1)
        assert out["bytes"] == len(step) + (len(record("user", 1, "not touched")) if k == 0 else reread[k]), k
    full = Store(spark, str(tmp_path / "full"))
    indexer.refresh(full, str(tmp_path / "in"))
    for name in ("sessions", "chunks", "usage", "stats", "tool_lines"):
        assert table(store, name) == table(full, name), name
    assert table(store, "files", "modified") == table(full, "files", "modified")
    assert [r[0] for r in store.read("vectors").select("chunk_id").orderBy("chunk_id").collect()] == [r[0] for r in full.read("chunks").select("chunk_id").orderBy("chunk_id").collect()]
    assert sum("Result:" in r["text"] for r in store.read("chunks").collect()) == 4
    # no longer the same bytes before the old end: indexed whole
    rewritten = content.replace(b"the end", b"an end!") + b"\n" + record("user", 15, "more")
    (d / "grows.jsonl").write_bytes(rewritten)
    assert indexer.refresh(store, str(tmp_path / "in"))["bytes"] == len(rewritten)
    assert {r["text"] for r in store.read("chunks").collect()} >= {"an end!", "more"}
    # a run that was cut short after it wrote sessions: the rest is made anew, and nothing counts twice
    with open(d / "grows.jsonl", "ab") as f:
        f.write(b"\n" + call(16))
    with monkeypatch.context() as m:
        real = store.replace
        m.setattr(store, "replace", lambda name, *a, **b: real(name, *a, **b) if name == "sessions" else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            indexer.refresh(store, str(tmp_path / "in"))
    size = (d / "grows.jsonl").stat().st_size
    assert indexer.refresh(store, str(tmp_path / "in"))["bytes"] == size
    assert store.read("usage").agg(F.sum("input_tokens")).first()[0] == 2 + 6 + 10 + 16
