import hashlib
import json

import pandas as pd
import pytest

from loomwork.plans import schedule
from loomwork.sources import archives, stores
from loomwork.streaming import queues


def test_versions_commit_conflict_recovery(spark, tmp_path):
    t = stores.VersionedTable(spark, str(tmp_path / "t"))
    assert t.current() is None
    assert t.commit(spark.range(3)) == 1 and t.commit(spark.range(5), expected=1) == 2
    with pytest.raises(stores.VersionConflict):
        t.commit(spark.range(1), expected=1)
    assert t.read().count() == 5 and t.read(1).count() == 3
    (tmp_path / "t" / "commit.lock").touch()
    with pytest.raises(stores.VersionConflict):
        t.commit(spark.range(1))
    (tmp_path / "t" / "commit.lock").unlink()
    assert t.current() == 2 and len(t.collect_unreachable(1)) == 2
    assert t.backup(str(tmp_path / "copy")) == 5
    assert t.restore(str(tmp_path / "copy")) == 3
    told = json.loads((tmp_path / "t" / "current").read_text())
    (tmp_path / "t" / "current").write_text(json.dumps(told | {"version": 9}))
    with pytest.raises(ValueError):
        t.current()


def test_content_store(spark, tmp_path):
    store = stores.ContentStore(tmp_path, quota=10)
    keys = []
    for data in (b"aaaa", b"bbbb", b"cccc"):
        keys.append(hashlib.sha256(data).hexdigest())
        store.put(keys[-1], data)
    assert store.get(keys[2]) == b"cccc"
    with pytest.raises(FileNotFoundError):
        store.get(keys[0])
    with pytest.raises(ValueError):
        store.put(keys[0], b"other")
    assert {r.key: r.bytes for r in store.manifest(spark).collect()} == {keys[1]: 4, keys[2]: 4}


def test_remote_store_tries_again():
    class Flaky:
        def __init__(self):
            self.calls, self.held = 0, {}

        def head(self, key):
            return (200 if key in self.held else 404), b""

        def put(self, key, data):
            self.calls += 1
            if self.calls < 2:
                raise OSError
            self.held[key] = data
            return 201, b""

        def get(self, key):
            return (200, self.held[key]) if key in self.held else (404, b"")

    remote = stores.RemoteStore(Flaky(), wait=lambda n: None)
    key = hashlib.sha256(b"x").hexdigest()
    remote.put(key, b"x")
    assert remote.get(key) == b"x"
    with pytest.raises(KeyError):
        remote.get("0" * 64)


def test_sinks(spark, tmp_path):
    ring = stores.RingSink(2)
    for i in range(4):
        ring.emit({"i": i})
    assert ring.dropped == 2 and ring.pop() == {"i": 0}
    stores.write_events(spark.createDataFrame([('quote"', 1)], "kind string, n int"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().kind == 'quote"'
    df = stores.ring(spark.createDataFrame([(i, "k") for i in range(5)], "o long, k string"), "o", 3, ["k"])
    assert df.count() == 3 and df.first().dropped == 2


def test_archives(spark):
    rows = [(w, i, 2, i, f"{w}{i}".encode()) for w in "ab" for i in range(1, 5)]
    df = spark.createDataFrame(rows, "w string, sequence long, kind int, utc_ms long, payload binary")
    back = archives.unpack(archives.pack(df, "w"), "w")
    assert sorted((r.w, r.sequence, r.kind, r.utc_ms, bytes(r.payload)) for r in back.collect()) == rows


def test_schedule():
    s = schedule.System
    plan = schedule.compile_schedule([s(1, writes=frozenset("a")), s(2, reads=frozenset("a")), s(3, writes=frozenset("b")), s(4, "startup")])
    assert plan == [("startup", [[4]]), ("update", [[1, 3], [2]])]
    turned = schedule.compile_schedule([s(1, writes=frozenset("a"), after=frozenset({2})), s(2, reads=frozenset("a"))])
    assert turned == [("update", [[2], [1]])]
    for bad in ([s(1, after=frozenset({2})), s(2, after=frozenset({1}))], [s(1, after=frozenset({9}))], [s(1, after=frozenset({2})), s(2, "render")]):
        with pytest.raises(schedule.ScheduleError):
            schedule.compile_schedule(bad)
    a = schedule.Access
    assert schedule.hazard_plan([a(1, ("f",), "write", page=1), a(2, ("f",), "write", page=2), a(3, ("f",), "read")]) == [(1, 3, "raw"), (2, 3, "raw")]
    m = schedule.Migrations()
    m.register(1, 1, "x")
    m.register(1, 2, "x", lambda v: v + 1)
    assert m.migrate(1, 1, 5) == 6
    for args, why in (((1, 2, "x"), "VersionRegression"), ((1, 4, "x", lambda v: v), "MigrationGap"), ((2, 1, "x"), "DuplicateName")):
        with pytest.raises(ValueError, match=why):
            m.register(*args)


def test_inbox_stream_goes_on(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def add(name, rows):
        pd.DataFrame(rows, columns=["user_id", "event_type", "event_id"]).to_parquet(src / f"{name}.parquet")

    add("a", [(1, "x", 5), (1, "x", 4), (2, "y", 1)])
    got = queues.run_inbox(spark, f"file://{src}", "", ["user_id", "event_type"], "event_id", f"file://{out}")
    assert sorted(map(tuple, got.select("user_id", "event_type", "event_id").collect())) == [(1, "x", 4), (2, "y", 1)]
    add("b", [(1, "x", 1), (3, "z", 9)])
    got = queues.run_inbox(spark, f"file://{src}", "", ["user_id", "event_type"], "event_id", f"file://{out}")
    assert sorted(map(tuple, got.select("user_id", "event_type", "event_id").collect())) == [(1, "x", 4), (2, "y", 1), (3, "z", 9)]


def test_fold_stream(spark, tmp_path):
    src = tmp_path / "ev"
    spark.createDataFrame([("a", 1, "go"), ("a", 2, "stop"), ("b", 1, "go")], "k string, sequence long, kind string").write.parquet(str(src))
    stream = spark.readStream.schema("k string, sequence long, kind string").parquet(str(src))
    q = queues.fold_stream(stream, "k", lambda state, e: e["kind"], "new").writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("folded").collect())) == [("a", "stop", 2), ("b", "go", 1)]
