"""The stream of file events: a debounce, and each event once, whatever stops the query."""

import os
import time

import pytest

from palimpsest.streaming import files as fe


def reader(tmp_path, **more):
    return fe.FileEventsReader({"path": str(tmp_path / "in"), "journal": str(tmp_path / "journal"), "settle": "0.05"} | more)


def told(r, at, wait=0.1, tries=3):
    """Events of the next batch, names only, and its offset."""
    for _ in range(tries):
        events, to = r.read(at)
        events = [(e[0], os.path.basename(e[1])) for e in events]
        if events:
            break
        time.sleep(wait)
    return events, to


def test_events_debounce_and_restart(tmp_path, monkeypatch):
    d = tmp_path / "in" / "deep"
    r = reader(tmp_path)
    assert told(r, r.initialOffset(), 0, 1) == ([], {"batch": 0})  # no folder yet
    d.mkdir(parents=True)
    (d / "a.jsonl").write_text("1")
    (d / "b.jsonl").write_text("1")
    (d / "c.txt").write_text("1")
    assert list(r.read({"batch": 0})[0]) == []  # not quiet yet
    events, one = told(r, {"batch": 0})
    assert events == [("create", "a.jsonl"), ("create", "b.jsonl")] and one == {"batch": 1}
    (d / "a.jsonl").write_text("22")
    os.remove(d / "b.jsonl")
    assert list(r.read(one)[0]) == []
    (d / "a.jsonl").write_text("333")  # changes again before it is quiet: one event
    events, two = told(r, one)
    assert sorted(events) == [("modify", "a.jsonl"), ("remove", "b.jsonl")] or events == [("remove", "b.jsonl")]
    if len(events) == 1:
        assert told(r, two)[0] == [("modify", "a.jsonl")]
    # another process: a batch that wasn't finished is told again as it was, and nothing else twice
    again = reader(tmp_path)
    assert told(again, one)[0] == events and [x[0] for x in again.readBetweenOffsets({"batch": 0}, one)] == ["create", "create"]
    last = {"batch": len(os.listdir(tmp_path / "journal"))}
    assert told(again, last, tries=2) == ([], last)


def test_journals_are_cut(tmp_path, monkeypatch):
    monkeypatch.setattr(fe, "WHOLE", 3)
    (tmp_path / "in").mkdir()
    r, at = reader(tmp_path, settle="0"), {"batch": 0}
    for k in range(14):
        (tmp_path / "in" / f"{k}.jsonl").write_text("x")
        if k % 2:
            os.remove(tmp_path / "in" / f"{k - 1}.jsonl")
        events, at = told(r, at)
        assert len(events) == 1 + k % 2
        r.commit(at)
    assert at == {"batch": 14} and len(os.listdir(tmp_path / "journal")) < 10
    assert told(reader(tmp_path, settle="0"), at, tries=1) == ([], at)
    fresh = reader(tmp_path)
    fresh._know(14)
    assert fresh.known == r.known == r.list()


@pytest.mark.parametrize("stop", [False, True])
def test_a_query_that_starts_again_sees_each_event_once(spark, tmp_path, stop):
    root, seen = tmp_path / "in", {}  # by batch: one that was stopped before Spark noted its end comes again, the same
    root.mkdir()

    def start(fail=False):
        def batch(rows, n):
            got = [(r["event"], os.path.basename(r["path"])) for r in rows.collect()]
            if fail and got:
                raise RuntimeError("stopped within a batch")
            assert seen.setdefault(n, got) == got

        rows = fe.file_events(spark, str(root), str(tmp_path / "journal"), settle=0.01)
        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    def until(n, q):
        for _ in range(200):
            if sum(map(len, seen.values())) >= n or not q.isActive:
                break
            time.sleep(0.1)

    (root / "a.jsonl").write_text("1")
    q = start()
    until(1, q)
    q.stop()
    (root / "b.jsonl").write_text("1")
    if stop:
        q = start(fail=True)
        for _ in range(200):
            if not q.isActive:
                break
            time.sleep(0.1)
        assert q.exception() is not None
    os.remove(root / "a.jsonl")
    q = start()
    until(3, q)
    (root / "b.jsonl").write_text("22")
    until(4, q)
    q.stop()
    assert sorted(x for got in seen.values() for x in got) == [("create", "a.jsonl"), ("create", "b.jsonl"), ("modify", "b.jsonl"), ("remove", "a.jsonl")]
