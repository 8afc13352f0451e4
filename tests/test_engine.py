"""Transcripts, indexing and the engine end to end, on files made here."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.facade import Engine
from palimpsest.sources import store as store_module
from palimpsest.sources import transcripts as tr
from palimpsest.sources.store import Store
from palimpsest.streaming import indexer


def line(**x):
    return json.dumps(x)


def said(role, text, at, **more):
    return line(type=role, uuid=f"{role}-{at}", timestamp=f"2025-01-01T00:{at:02}:00Z", message={"role": role, "content": text, **more})


@pytest.fixture()
def root(tmp_path):
    d = tmp_path / "in" / "-proj"
    (d / "main" / "subagents").mkdir(parents=True)
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 3}
    rows = [
        line(type="user", uuid="u1", timestamp="2025-01-01T00:00:00Z", cwd="/home/x", message={"role": "user", "content": "How do I parse src/lib.rs with serde?"}),
        line(type="assistant", uuid="a1", timestamp="2025-01-01T00:01:00Z", message={"role": "assistant", "model": "m1", "usage": usage, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Use serde_json. password = \"abcdefgh12\""}, {"type": "tool_use", "id": "t", "name": "Read", "input": {"path": "src/lib.rs"}}]}),
        line(type="attachment", uuid="x", parentUuid="a1", attachment={"type": "tool-result", "result": "file content"}),
        "{not even json", "   ", line(type="ai-title", aiTitle="Parsing with serde"), line(type="weird"), line(nothing=1), "",
    ]
    (d / "main.jsonl").write_text("\n".join(rows))
    (d / "main" / "subagents" / "agent-xyz.jsonl").write_text(said("user", "explore the crates folder", 2))
    (d / "main" / "subagents" / "agent-xyz.meta.json").write_text(line(agentType="Explore", description="d"))
    (d / "main" / "other.jsonl").write_text(said("user", "ignored", 3))
    return str(tmp_path / "in")


def test_discover_and_parse(spark, root):
    files = {r["session_id"]: r for r in tr.discover(spark, root).collect()}
    assert set(files) == {"main", "xyz"} and files["xyz"]["is_sidechain"] and files["xyz"]["parent_session"] == "main" and files["xyz"]["agent_type"] == "Explore"
    assert not files["main"]["is_sidechain"] and files["main"]["project_id"] == "-proj"
    parsed = tr.lines(spark, tr.discover(spark, root)).cache()
    stats = {os.path.basename(r["path"]): (r["total_lines"], r["bad_lines"]) for r in tr.parse_stats(parsed).collect()}
    assert stats["main.jsonl"] == (8, 2)
    records = tr.records(parsed)
    first = records.where("uuid = 'a1'").first()
    assert [b["kind"] for b in first["blocks"]] == ["thinking", "text", "tool_use"] and first["blocks"][2]["input_preview"] == '{"path":"src/lib.rs"}'
    assert first["turn_index"] == 1 and first["cache_read_tokens"] == 7
    assert tr.discover(spark, root + "/none").count() == 0


def test_index_grow_and_recall(spark, root, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    got = e.refresh(root)
    assert got["files"] == 2 and got["chunks"] == 4 and got["misses"] == 4
    assert e.refresh(root) == {"files": 0, "chunks": 0, "hits": 0, "misses": 0, "bytes": 0}
    chunks = {r["chunk_id"]: r for r in e.store.read("chunks").collect()}
    assert chunks["main:1:0"]["text"].endswith("[REDACTED:secret-assignment]") and chunks["main:1:1"]["text"] == 'Tool call: Read\nInput: {"path":"src/lib.rs"}\nResult:\nfile content'
    s = e.store.read("sessions").where("session_id = 'main'").first()
    assert (s["user_count"], s["assistant_count"], s["message_count"], s["cwd"], s["ai_title"]) == (1, 1, 2, "/home/x", "Parsing with serde")
    e.save_session_summary("main", "A summary.")
    with open(f"{root}/-proj/main.jsonl", "a") as f:
        f.write("\n" + said("user", "And what about toml files?", 9))
    again = e.refresh(root)
    assert again["files"] == 1 and again["chunks"] == 1 and again["hits"] == 0 and again["misses"] == 1
    assert e.store.read("sessions").where("session_id = 'main'").first()["summary"] == "A summary."
    out = e.recall("what about parsing toml files with serde", "-proj", session="s1")
    items = out["items"].orderBy("rank").collect()
    assert items and any("toml" in r["text"] for r in items) and out["stats"].first()["chunk_count"] == 5
    assert e.store.read("hits").count() == len(items) and e.metrics().count() == 1
    assert "toml" in e.get_session_transcript("main") and e.list_projects().first()["session_count"] == 2
    with pytest.raises(ValueError):
        e.get_session_transcript("../x")
    assert e.search("toml files", 3).count() == 3
    e.cluster()
    assert e.graph()[0].where("kind = 'session'").count() == 2


def test_summaries_are_cached_by_input(spark, root, tmp_path):
    asked = []

    def complete(system, user):
        asked.append(user)
        if "explore" in user:
            raise RuntimeError("no reply")
        return 'Here it is:\n```json\n{"text": "Parsing.", "bullets": ["uses serde"], "decisions": [], "artifacts": ["src/lib.rs"]}\n```'

    e = Engine(spark, str(tmp_path / "store"), complete=complete)
    e.refresh(root)
    assert e.summarize(session="main") == {"summarized": 1, "cached": 0, "skipped": 0, "failed": 0}
    assert e.get_session("main")["summary"] == "Parsing.\n- uses serde\n- src/lib.rs"
    assert e.summarize(force=True) == {"summarized": 1, "cached": 1, "skipped": 0, "failed": 1} and len(asked) == 2
    with open(f"{root}/-proj/main.jsonl", "a") as f:
        f.write("\n" + said("user", "More about toml", 9))
    e.refresh(root)
    assert e.summarize(session="main")["cached"] == 0 and len(asked) == 3  # another input, another hash
    assert e.summarize() == {"summarized": 0, "cached": 0, "skipped": 0, "failed": 0}
    assert Engine(spark, str(tmp_path / "store")).summarize() == {"summarized": 0, "cached": 0, "skipped": 0, "failed": 0}
    raw = e._value(__import__("palimpsest.functions.text", fromlist=["x"]).summary_reply(F.lit("just prose {")))
    assert raw["text"] == "just prose {" and raw["bullets"] == []
    assert e.get_chunk("main:0:0")["role"] == "user" and e.get_chunk("none") is None
    with pytest.raises(ValueError):
        e.get_chunk("../x")


def test_topics_are_named(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), complete=lambda s, u: f'"Topic of {u.count("Sample")}."\nmore')
    rows = [(f"s:{k}:0", "s", "p", k, 0, "user", "user_prompt", f"text {k} about things", 4, 0, None, None, None) for k in range(6)]
    e.store.write("chunks", spark.createDataFrame(rows, e.store.read("chunks").schema))
    e.store.write("vectors", spark.createDataFrame([(f"s:{k}:0", "s", "p", None, [1.0, 0.001 * k]) for k in range(6)], e.store.read("vectors").schema))
    e.cluster()
    topic = e.list_topics().first()
    assert topic["size"] == 6
    assert e.name_topics() == 1 and e.list_topics().first()["label"] == "Topic of 3"
    assert e.name_topics() == 0
    e.cluster()
    assert e.list_topics().first()["label"] == "Topic of 3"  # as its members stayed
    e.name_topic(topic["topic_id"], "By hand")
    assert e.list_topics().first()["label"] == "By hand"


def test_auto_promotion_and_hook(spark, root, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    with open(f"{root}/-proj/main.jsonl", "a") as f:
        f.write("\n" + line(type="user", uuid="u9", timestamp="2025-01-02T00:00:00Z", cwd=str(home), message={"role": "user", "content": "What about parsing toml with serde now?"}))
    e = Engine(spark, str(tmp_path / "store"), complete=lambda s, u: "* Uses serde\n* Uses serde\n• Rust", config=config.Config(auto_promote=True))
    e.refresh(root)
    for s in ("s1", "s2", "s3"):
        out = e.recall("what about parsing with serde", "-proj", session=s, limit=1)
    assert out["truncated"] and len(out["items"].collect()) == 1
    assert (home / "NOTES.md").read_text().count("Uses serde") == 2  # as the reply has it; the memory of it is one
    assert e.list_memories("-proj").count() == 2 and e.count_memories("-proj") == 2 and e.has_memory("-proj", "Rust")
    assert e.get_memory(e.list_memories("-proj").first()["id"])["source"] == "distilled"
    text = e.hook("what about parsing toml with serde", session="s1", cwd="/proj")
    assert text.split("\n")[0].endswith("indexed chunks.") and "### " in text and "toml" in text
    assert e.hook("too short", cwd="/proj") == ""
    bad = Engine(spark, str(tmp_path / "store"), complete=lambda s, u: 1 / 0, config=config.Config(auto_promote=True))
    assert bad.recall("what about parsing with serde", "-proj", session="s4")["items"].count() > 0


def test_dimensions_are_checked(spark, root, tmp_path):
    def embed(n):
        return lambda rows: rows.select("hash", F.array(*(F.lit(1.0) for _ in range(n))).alias("embedding"))

    Engine(spark, str(tmp_path / "store"), embed(3)).refresh(root)
    with open(f"{root}/-proj/main.jsonl", "a") as f:
        f.write("\n" + said("user", "Another prompt", 9))
    other = Engine(spark, str(tmp_path / "store"), embed(4))
    with pytest.raises(ValueError):
        other.refresh(root)
    with pytest.raises(ValueError):
        other.recall("what about this", "-proj")
    assert Engine(spark, str(tmp_path / "store"), embed(3)).refresh(root)["files"] == 1


def test_store_survives_cut_writes(spark, tmp_path, monkeypatch):
    """A write that stops before its list is made, or within it, loses nothing, whatever it had removed or written."""
    store = Store(spark, str(tmp_path / "store"), depth=2)
    rows = lambda *ids_: spark.createDataFrame([(i, None, k) for k, i in enumerate(ids_)], "input_hash string, session_id string, text int")
    shaped = lambda df: df.selectExpr("input_hash", "session_id", "'m' as model", "cast(text as string) as text")
    read = lambda: {r["input_hash"]: r["text"] for r in store.read("summaries").collect()}
    assert read() == {}
    store.replace("summaries", shaped(rows(*"abcdefgh")))
    before = read()
    assert len(before) == 8
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: 1 / 0)
        for cut in (lambda: store.replace("summaries", shaped(rows("a"))), lambda: store.write("summaries", shaped(rows("z")))):
            with pytest.raises(ZeroDivisionError):
                cut()
            assert read() == before
    with open(tmp_path / "store" / "summaries" / "v2.json", "w") as f:
        f.write('{"parts": {"2.')  # cut within the list
    assert read() == before
    store.remove("summaries", shaped(rows("b")))
    assert read() == {k: v for k, v in before.items() if k != "b"}


def test_a_file_rewrites_only_its_buckets(spark, root, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "store"))
    e.refresh(root)
    before = e.store.current("chunks")["parts"]
    assert len(before) == 16 and sum(map(bool, before.values())) == 2  # two sessions, in two of the buckets
    with open(f"{root}/-proj/main.jsonl", "a") as f:
        f.write("\n" + said("user", "And what about toml files?", 9))
    e.refresh(root)
    after = e.store.current("chunks")["parts"]
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    os.utime(f"{root}/-proj/main/subagents/agent-xyz.jsonl", (1, 1))  # another time, the same content
    assert e.refresh(root)["files"] == 0
    row = e.store.read("files").where("session_id = 'xyz'").first()
    assert row["modified"].year == 1970 and row["offset"] == row["length"] > 0
    monkeypatch.setattr(store_module, "MOST_FOLDERS", 3)
    for k in range(6):
        e.store.append("metrics", spark.createDataFrame([(None, str(k), k, k)], e.store.read("metrics").schema))
    assert e.store.read("metrics").count() == 6 and len(e.store.current("metrics")["parts"]["all"]) <= 3


def test_progress_failures_and_events(spark, root, tmp_path, monkeypatch):
    e, seen = Engine(spark, str(tmp_path / "store")), []
    for k in range(3):
        with open(f"{root}/-proj/more{k}.jsonl", "w") as f:
            f.write(said("user", f"Prompt number {k}", k))
    mine = e.events.subscribe()
    real = tr.with_sha

    def without(spark, files):  # a file that goes between listing and reading
        os.remove(f"{root}/-proj/more1.jsonl")
        return real(spark, files)

    monkeypatch.setattr(tr, "with_sha", without)
    got = e.refresh(root, lambda done, total: seen.append((done, total)))
    assert got["files"] == 4 and got["failed"] == 1 and seen == [(4, 4)]
    assert mine.take() == [got] and mine.take() == []
    monkeypatch.setattr(tr, "with_sha", real)
    assert e.refresh(root, collect_gone=True)["files"] == 0
    assert e.store.read("sessions").count() == 4 and not e.health()["indexing"]
    seen.clear()
    for k in range(5):
        with open(f"{root}/-proj/next{k}.jsonl", "w") as f:
            f.write(said("user", f"Next prompt {k}", k))
    indexer.refresh(e.store, root, progress=lambda done, total: seen.append((done, total)), step=2)
    assert seen[-1] == (5, 5) and len(seen) > 1 and e.store.read("sessions").count() == 9
    os.remove(f"{root}/-proj/next0.jsonl")
    assert indexer.refresh(e.store, root)["files"] == 0 and e.store.read("sessions").count() == 9  # kept
    indexer.refresh(e.store, root, collect_gone=True)
    assert e.store.read("sessions").count() == 8
    behind = indexer.Events(2)
    slow = behind.subscribe()
    for k in range(4):
        behind.publish(k)
    assert slow.closed and slow.take() == [0, 1] and behind.subscribers == []


def test_follow(spark, root, tmp_path):
    import time

    e = Engine(spark, str(tmp_path / "store"))
    mine = e.events.subscribe()
    q = e.follow(root, every="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            if mine.held:
                break
    finally:
        q.stop()
    assert mine.take()[0]["files"] == 2 and e.store.read("sessions").count() == 2


def test_tools(spark, root, tmp_path):
    from palimpsest import tools

    e = Engine(spark, str(tmp_path / "store"))
    e.refresh(root)
    assert {s["name"] for s in tools.schemas()} == set(tools.TOOLS) and len(tools.TOOLS) == 13
    assert all(s["inputSchema"]["required"] == [r for r in s["inputSchema"]["required"] if r in s["inputSchema"]["properties"]] for s in tools.schemas())
    assert "recall(query" in tools.call(e, "help") and [r["project_id"] for r in tools.call(e, "list_projects")] == ["-proj"]
    assert tools.call(e, "recall", {"query": "parse with serde", "limit": 99})["items"]
    assert "serde" in tools.call(e, "get_session_transcript", {"session": "main", "most_bytes": 5000})
    own = tools.call(e, "remember", {"content": "Serde parses", "source": "user"})[0]
    assert e.get_memory(own)["project_id"] == "-proj" and e.get_memory(own)["source"] == "user"  # the project that was active last
    everywhere = tools.call(e, "remember", {"content": "Always test", "global": True})[0]
    assert [r["id"] for r in tools.call(e, "list_memories", {"global": True})] == [everywhere] and [r["id"] for r in tools.call(e, "list_memories")] == [own]
    with pytest.raises(ValueError, match="project"):
        tools.call(Engine(spark, str(tmp_path / "none")), "list_memories")
    for name, arguments in (("none", {}), ("recall", {}), ("recall", {"query": 1}), ("forget", {"id_": "x", "y": 1}), ("list_sessions", {"limit": True})):
        with pytest.raises(ValueError):
            tools.call(e, name, arguments)


def test_chunks_by_a_vocabulary(spark, root, tmp_path):
    """Windows and counts of a byte-pair vocabulary, against its library."""
    import public_tokenizers

    from palimpsest.functions.tokens import Bpe

    bpe = Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), special=(("<|end|>", 50256),))
    e = bpe.encoding()
    text = "Ünïcode wörds and more of them, 日本語 too. " * 60
    with open(f"{root}/-proj/long.jsonl", "w") as f:
        f.write(line(type="assistant", uuid="a", timestamp="2025-01-01T00:01:00Z", message={"role": "assistant", "content": [{"type": "text", "text": text}, {"type": "text", "text": "short <|end|>"}]}))
    engine = Engine(spark, str(tmp_path / "store"), tokens=bpe)
    engine.refresh(root)
    got = [r for r in engine.store.read("chunks").where("session_id = 'long'").orderBy("sub_index").collect()]
    ids, want = e.encode(text), []
    for s in range(0, len(ids), 350):
        raw = e.decode_bytes(ids[s : s + 400])
        if raw.decode(errors="replace").encode() == raw:
            want.append(raw.decode())
        if s + 400 >= len(ids):
            break
    assert len(ids) > 1000 and [r["text"] for r in got] == [*want, "short <|end|>"] and got[-1]["token_count"] == len(e.encode("short ")) + 1
    assert all(r["token_count"] == len(e.encode(r["text"], allowed_special="all")) for r in got)


def test_distil_supersedes_within_the_batch():
    from palimpsest.operators.memory import distil, facts_of

    assert facts_of(["- a", "a", " - b ", "", "- "]) == ["a", "- b"]
    row = lambda i, v, **x: {"id": i, "content": i, "embedding": v, "updated_at": 9, "pinned": False} | x
    out = distil([row("old", [1.0, 0.0], updated_at=1)], [row("x", [1.0, 0.01]), row("y", [0.0, 1.0]), row("z", [0.01, 1.0])])
    assert [(r["id"], r["content"]) for r in out] == [("old", "x"), ("y", "z")]


def test_labels_and_names(spark):
    from palimpsest.functions import text as tx

    got = spark.createDataFrame([("tool call: Read Input: {}", "ToolCall")], "a string, b string").select(tx.clean_label("a", "topic"), tx.clean_label("a", "session"), tx.enum_name("b"), tx.enum_name("b", "-")).first()
    assert tuple(got) == ("Read", "tool call: Read Input: {}", "tool_call", "tool-call")


def test_watch(spark, root, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    q = indexer.watch(store, root, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None and store.read("sessions").count() == 2


def test_memories(spark, tmp_path):
    axes = {"deploy": 0, "tests": 1, "style": 2}

    def embed(rows):
        v = [F.when(F.lower("text").contains(w), 1.0).otherwise(0.0) for w in axes]
        return rows.select("hash", F.array(*v, F.lit(0.01)).alias("embedding"))

    e = Engine(spark, str(tmp_path / "store"), embed)
    a, what = e.remember("p", "We deploy on Monday", now=1)
    assert what == "added"
    assert e.remember("p", "We deploy on Tuesday", now=2) == (a, "superseded")
    assert e.remember("q", "We deploy on Friday", now=3)[1] == "added"
    b, _ = e.remember("p", "Style: four spaces", scope="always", now=4)
    g, _ = e.remember("__global__", "Tests go beside code", scope="glob", globs=["**/*.rs"], now=5)
    assert [r["content"] for r in e.list_memories("p").collect()] == ["Style: four spaces", "We deploy on Tuesday"]
    from palimpsest.operators import memory

    found = [r.asDict() for r in memory.candidates(e.store.read("memories"), "p", "fix src/main.rs", e.vector("deploy")).collect()]
    assert [(r["tier"], r["id"]) for r in sorted(found, key=lambda r: (r["tier"], r["place"]))] == [(1, b), (2, g), (3, a)]
    assert [r["id"] for r in memory.admit(found, 5)] == [b] and [r["id"] for r in memory.admit(found, 1000, floor=0.5)] == [b, g, a]
    assert e.update_memory(a, pinned=True) and not e.update_memory("none") and e.forget(g) and not e.forget(g)
    assert e.remember("p", "We deploy on Sunday", now=6)[1] == "added"  # pinned ones aren't superseded
    for bad in ({"scope": "glob"}, {"scope": "x"}, {"source": "x"}, {"scope": "glob", "globs": ["{a"]}, {"scope": "glob", "globs": ["a"] * 33}):
        with pytest.raises(ValueError):
            e.remember("p", "x", **bad)


def test_reconcile_and_splice():
    from palimpsest.operators.memory import reconcile, splice

    known = [{"id": "a", "pinned": False}, {"id": "b", "pinned": True}]
    assert reconcile("\n add", known) == ("add", None) and reconcile("UPDATE #1", known) == ("update", known[0]) and reconcile("UPDATE 2", known) == ("noop", known[1])
    assert reconcile("NOOP 9", known) == ("local", None) and reconcile("", known) == ("local", None) and reconcile("maybe", known) == ("local", None)
    one = splice("top\n", "x", "<s>", "<e>")
    assert one == "top\n\n<s>\nx\n<e>\n" and splice(one, "y", "<s>", "<e>") == "top\n\n<s>\ny\n<e>\n" and splice("", "z", "<s>", "<e>") == "<s>\nz\n<e>\n"


def test_promote(spark, root, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), complete=lambda s, u: "* Uses serde\n\n• Rust")
    e.refresh(root)
    for s in ("s1", "s2", "s3"):
        e.recall("what about parsing with serde", "-proj", session=s)
    text = e.promote("-proj", "# Notes\n")
    assert "- Uses serde\n- Rust" in text and e.promote("-proj", "# Notes\n") is None
    assert e.list_memories("-proj").count() == 2


def test_config(tmp_path):
    p = str(tmp_path / "c.toml")
    assert config.load(p) == config.Config()
    c = config.Config(dedupe_threshold=0.2, hook=config.HookConfig(limit=7))
    config.save(c, p)
    assert config.load(p) == c and c.dedupe() == 0.5
    with open(p, "w") as f:
        f.write("a = [")
    with pytest.raises(ValueError):
        config.load(p)
    with pytest.raises(ValueError):
        config.validate(config.Config(hook=config.HookConfig(scope="x")))


def test_json_of_tables(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    one.write("edges", spark.createDataFrame([("e", "k", "a", "b", 0.5)], one.read("edges").schema))
    one.write("topic_names", spark.createDataFrame([("t", "name", None)], one.read("topic_names").schema))
    for name in ("edges", "topic_names"):
        one.export_json(name, str(tmp_path / name))
        with open(tmp_path / name / "more.json", "w") as f:
            f.write('{not json\n{"label": "no key"}\n')
        assert two.import_json(name, str(tmp_path / name)) == (1 if name == "edges" else 2)
    assert two.read("edges").where("edge_id = 'e'").first()["weight"] == 0.5 and two.read("topic_names").first()["label"] == "name"


def test_settings(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.put_settings(str(tmp_path / "c.toml"), auto_promote=True, hook={"limit": 7})["hook"]["limit"] == 7
    assert config.load(str(tmp_path / "c.toml")) == e.config
    for bad in ({"hook": {"limit": 0}}, {"hook": {"none": 1}}, {"none": 1}):
        with pytest.raises(ValueError):
            e.put_settings(**bad)
    assert e.get_settings()["hook"]["limit"] == 7


def test_event_windows_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    q = indexer.event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from w").first()[0] == e.count()
    assert np.isclose(spark.sql("select sum(value) from w").first()[0], e.agg(F.sum("value")).first()[0])
