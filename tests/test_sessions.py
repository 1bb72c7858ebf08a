"""The session machine and the change feed, in micro-batches, over restarts, against plain models."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sievecast import streaming
from sievecast.streaming import feed, session

NAMES = [c.split()[0] for c in session.EVENT.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def event(session_id, seq, kind, tool=None, path=None, content=None, command=None, found=None):
    return dict(zip(NAMES, (session_id, seq, kind, tool, path, content, command, [dict(file_path=f, id=i) for f, i in found] if found is not None else None), strict=True))


class Stream:
    """Micro-batches from files; each run is a query of its own over the same checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n, self.out = spark, folder, 0, []
        (folder / "in").mkdir()

    def send(self, events):
        (self.folder / "in" / f"{self.n}.json").write_text("\n".join(map(json.dumps, events)))
        self.n += 1
        stream = self.spark.readStream.schema(session.EVENT).json(str(self.folder / "in"))
        q = session.session_actions(stream).writeStream.outputMode("append").option("checkpointLocation", str(self.folder / "c")).foreachBatch(lambda b, _: self.out.extend(map(tuple, b.collect()))).start()
        q.processAllAvailable()
        q.stop()
        rows, self.out = sorted(self.out, key=str), []
        return [r[1:5] + tuple(x for x in r[5:] if x is not None) for r in rows]


def test_a_crash_leaves_no_snapshot_to_the_next_turn(rocks, tmp_path):
    s = Stream(rocks, tmp_path)
    first = s.send([event("s", 1, "session_start"), event("s", 2, "tool_call", "edit", "a.ts", "old"), event("s", 3, "tool_execution_end", found=[("a.ts", "x"), ("a.ts", "y")])])
    assert first == [(2, 0, "snapshot", "a.ts", "old")]
    # the turn never ends; the query starts anew from its checkpoint; a tool that changes nothing comes, then an edit
    second = s.send([event("s", 4, "tool_execution_end"), event("s", 5, "tool_call", "edit", "a.ts", "newer"), event("s", 6, "tool_call", "edit", "a.ts", "newest")])
    assert second == [(4, 0, "stale", "a.ts"), (5, 0, "snapshot", "a.ts", "newer")]
    third = s.send([event("s", 7, "tool_execution_end", found=[("a.ts", "y")]), event("s", 8, "context"), event("s", 9, "context")])
    assert third == [(8, 0, "report", None, 1, 1, True)]
    fourth = s.send([event("s", 10, "turn_end"), event("s", 11, "context"), event("s", 12, "tool_call", "bash", command="sed -i s/a/b/ c.ts"), event("s", 13, "tool_execution_end", found=[]), event("s", 14, "context")])
    assert fourth == [(10, 0, "lint", "a.ts"), (11, 0 + 1, "report", None, 1, 0, False), (14, 1, "report", None, 1, 0, False)]
    assert s.send([event("s", 15, "session_end"), event("s", 16, "context")]) == []


def random_events(seed, sessions=4, n=120):
    rng, out = random.Random(seed), []
    for k in range(sessions):
        for seq in range(n):
            kind = rng.choice(["tool_call"] * 4 + ["tool_execution_end"] * 4 + ["turn_end", "context", "context", "session_start", "session_end"][: 5 if rng.random() < 0.1 else 3])
            path = rng.choice(["a", "b", "c", None])
            found = [(f, f"{f}{i}") for f in "abc" for i in range(3) if rng.random() < 0.2] if rng.random() < 0.8 else None
            out.append(event(f"s{k}", seq, kind, rng.choice(["edit", "write", "bash", "read"]), path, rng.choice(["v1", "v2", None]), rng.choice(["sed -i x", "ls", None]), found))
    return out


def model(events):
    """The same by hand: one pass over a session's events, with everything looked up in what was."""
    out = []
    for name in sorted({e["session_id"] for e in events}):
        turn, snaps, edited, changed, open_, gone, pending, changing, said = 0, {}, set(), set(), {}, set(), False, False, False
        for e in (e for e in events if e["session_id"] == name):
            put = lambda *a, e=e: out.append((name, e["seq"], turn, *a))  # noqa: B023, E731
            k = e["kind"]
            if k.startswith("session"):
                turn, snaps, edited, changed, open_, gone, pending, changing, said = 0, {}, set(), set(), {}, set(), False, False, False
            if k == "tool_call" and e["tool_name"] in ("edit", "write"):
                changing = True
                if e["file_path"]:
                    changed.add(e["file_path"])
                    edited.add(e["file_path"])
                    if e["file_path"] not in snaps:
                        snaps[e["file_path"]] = e["content"] or ""
                        put("snapshot", e["file_path"], e["content"] or "", None, None, None)
            if k == "tool_call" and e["tool_name"] == "bash" and "-i" in (e["command"] or ""):
                changing = True
            if k == "tool_execution_end" and not changing:
                for f in sorted(snaps):
                    put("stale", f, None, None, None, None)
                snaps = {}
            elif k == "tool_execution_end":
                now = {x["id"]: x["file_path"] for x in e["found"] or []}
                for i in [i for i, f in open_.items() if f in changed and i not in now]:
                    gone.add(i)
                    del open_[i]
                open_.update(now)
                gone -= set(now)
                changed, changing, pending = set(), False, bool(open_ or gone)
            if k == "turn_end":
                for f in sorted(edited):
                    put("lint", f, None, None, None, None)
                pending = bool(open_ or gone) if edited else pending
                snaps, edited, changed = {}, set(), set()
                turn += 1
            if k == "context" and pending:
                put("report", None, None, len(open_), len(gone), not said)
                pending, said, gone = False, True, set()
    return sorted(out, key=str)


def test_random_sessions_in_batches_and_at_once(rocks, tmp_path):
    events = random_events(1)
    want = model(events)
    assert len({r[3] for r in want}) == 4
    batch = rocks.createDataFrame([tuple(e[n] for n in NAMES) for e in events], session.EVENT)
    assert sorted(map(tuple, session.session_actions(batch).collect()), key=str) == want
    s, got = Stream(rocks, tmp_path), []
    for k in range(0, 120, 40):
        got += s.send([e for e in events if k <= e["seq"] < k + 40])
    assert sorted(got, key=str) == sorted([r[1:5] + tuple(x for x in r[5:] if x is not None) for r in want], key=str)


def test_idle_sessions_go(rocks, tmp_path):
    """One query that runs on: with timers it looks at its sessions all the time, so no wait for it to be done."""
    (tmp_path / "in").mkdir()
    stream = rocks.readStream.schema(session.EVENT).json(str(tmp_path / "in"))
    out = []
    q = session.session_actions(stream, 1).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).start()

    def send(name, events, wanted):
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, events)))
        until = time.time() + 40
        while len(out) < wanted and time.time() < until:
            time.sleep(0.2)

    try:
        send("1.json", [event("s", 1, "tool_call", "edit", "a", "v"), event("s", 2, "tool_execution_end", found=[("a", "x")])], 1)
        time.sleep(3)
        send("2.json", [event("s", 3, "context"), event("s", 4, "tool_call", "edit", "a", "w")], 2)
    finally:
        q.stop()
    assert [r[1:6] for r in out] == [(1, 0, "snapshot", "a", "v"), (4, 0, "snapshot", "a", "w")]


def test_a_stream_needs_rocksdb(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError):
        session.session_actions(spark.readStream.schema(session.EVENT).json(str(tmp_path / "in")))


def test_event_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", "2024-01-01T00:10:00Z"), ("a", "2024-01-01T00:20:00Z"), ("b", "2024-01-01T05:00:00Z")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"kind": k, "ts": t}) for k, t in rows))
    stream = spark.readStream.schema("kind string, ts timestamp").json(str(tmp_path / "in"))
    out = []
    q = streaming.event_counts(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.kind, r.n) for r in out] == [("a", 2)]


# the change feed


def batch_of(spark, *rows):
    return spark.createDataFrame(rows, "id string, seq long, status string")


def rows_of(df):
    return sorted(map(tuple, df.select("id", "seq", "status").collect()), key=str)


def test_feed_replays_and_compaction(spark, tmp_path):
    f = feed.ChangeFeed(str(tmp_path / "t"), every=3)
    assert f.current(spark) is None and f.changes(spark) is None
    batches = [[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], [("b", 3, "z")], [("c", 1, "x"), (None, 1, "n")], [("a", 5, "w")], [("b", 2, "late")], [("d", 1, "x")], [("d", 2, "y")]]
    want = {}
    for n, rows in enumerate(batches):
        f.apply(batch_of(spark, *rows), n)
        f.apply(batch_of(spark, *rows), n)  # again, as after a crash
        for r in rows:
            if r[0] not in want or want[r[0]][1] < r[1]:
                want[r[0]] = r
        assert rows_of(f.current(spark)) == sorted(want.values(), key=str), n
    f.apply(batch_of(spark, ("a", 99, "replayed")), 1)  # a base has taken batch 1 in
    assert rows_of(f.current(spark)) == sorted(want.values(), key=str)
    assert f._numbers(spark, "base") == [2, 5] and f._numbers(spark, "changes") == [3, 4, 5, 6]
    assert [(r.batch, r.id) for r in f.changes(spark, 4).orderBy("batch", "id").collect()] == [(5, "d"), (6, "d")]


def test_a_half_written_base_is_not_read(spark, tmp_path):
    f = feed.ChangeFeed(str(tmp_path / "t"), every=2)
    for n in range(4):
        f.apply(batch_of(spark, ("a", n, str(n))), n)
    (tmp_path / "t" / "base" / "batch=3" / "_SUCCESS").unlink()
    assert rows_of(f.current(spark)) == [("a", 3, "3")]


def test_feed_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    f = feed.ChangeFeed(str(tmp_path / "t"), every=2)
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"id": f"k{i}", "seq": n}) for i in range(n, 4)))
        stream = spark.readStream.schema("id string, seq long").json(str(tmp_path / "in"))
        counted = stream.groupBy("id").agg(F.max("seq").alias("seq"), F.count("*").alias("n"))
        q = f.start(counted, str(tmp_path / "c"), "update")
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, f.current(spark).select("id", "seq", "n").collect())) == [("k0", 0, 1), ("k1", 1, 2), ("k2", 2, 3), ("k3", 2, 3)]
