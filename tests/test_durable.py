"""Batches of requests on empty and odd tables, and the parts that no query holds against SQL."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import codecs, hashing
from loomwork.operators import algorithms, dag, durable, ecs, resources, workflow
from loomwork.sources import stores

INSTANCE = "workflow_id long, tenant string, namespace string, status string, definition_id int, definition_version int, state_version long, state string, next_sequence long, last_processed long, updated_ms long"
INSTANCES = [(1, "t", "n", "running", 7, 1, 0, "a", 2, 1, 0), (2, "t", "n", "completed", 7, 1, 0, "b", 5, 4, 0)]


@pytest.fixture(scope="module")
def instances(spark):
    return spark.createDataFrame(INSTANCES, INSTANCE)


def test_empty_batches_change_nothing(spark, instances):
    tasks = spark.createDataFrame([(9, 1, "claimed", 2, 0, None)], "task_id long, workflow_id long, status string, claimed_epoch long, available_ms long, heartbeat_ms long")
    none = spark.createDataFrame([], "tenant string, namespace string, message_id long, workflow_id long, kind int, utc_ms long, arrival long, payload binary")
    got = durable.receive(none, none, instances, tasks)
    assert got.events.count() == got.tasks.count() == got.verdicts.count() == 0 and sorted(got.instances.collect()) == sorted(instances.collect())
    commits = spark.createDataFrame([], "arrival long, task_id long, workflow_id long, epoch long, state_version long, definition_id int, definition_version int, state string, status string, last_processed long, utc_ms long")
    history = spark.createDataFrame([], "workflow_id long, sequence long, kind int")
    children = spark.createDataFrame([], "parent_id long, workflow_id long, notified boolean")
    made = durable.commit_transitions(commits, instances, tasks, history, children, 2)
    assert sorted(made.instances.collect()) == sorted(instances.collect()) and sorted(made.tasks.collect()) == sorted(tasks.collect()) and made.notices.count() == 0
    archived, hot = durable.commit_archives(spark.createDataFrame([], "workflow_id long, first long, last long, events long"), instances, history, 0)
    assert archived.count() == hot.count() == 0


def test_transition_is_compare_and_set(spark, instances):
    tasks = spark.createDataFrame([(9, 1, "claimed", 2, 0), (8, 2, "claimed", 1, 0)], "task_id long, workflow_id long, status string, claimed_epoch long, available_ms long")
    history = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "workflow_id long, sequence long, kind int")
    children = spark.createDataFrame([(2, 1, False)], "parent_id long, workflow_id long, notified boolean")
    row = lambda arrival, task, workflow, epoch, version: (arrival, task, workflow, epoch, version, 7, 1, "new", "failed", 1, 50)
    commits = [row(1, 9, 1, 1, 0), row(2, 9, 1, 2, 5), row(3, 9, 1, 2, 0), row(4, 9, 1, 2, 0), row(5, 8, 2, 2, 0), row(6, 99, 77, 2, 0)]
    df = spark.createDataFrame(commits, "arrival long, task_id long, workflow_id long, epoch long, state_version long, definition_id int, definition_version int, state string, status string, last_processed long, utc_ms long")
    made = durable.commit_transitions(df, instances, tasks, history, children, 2)
    assert {r.arrival: r.verdict for r in made.verdicts.collect()} == {1: "StaleRuntimeEpoch", 2: "Conflict", 3: "committed", 4: "Conflict", 5: "Conflict", 6: "Conflict"}
    one = made.instances.where("workflow_id = 1").first()
    assert (one.state, one.status, one.state_version, one.last_processed) == ("new", "failed", 1, 1)
    assert made.tasks.where("task_id = 9").first().status == "ready"  # an event came meanwhile
    assert [(r.workflow_id, r.child_id, r.kind) for r in made.notices.collect()] == [(2, 1, 12)]


def test_recorded_values_and_commands():
    context = durable.Recorded([5, 6], 1)
    assert [context.next_random(), context.next_random()] == [5, 6]
    with pytest.raises(LookupError, match="MissingRecordedRandom"):
        context.next_random()
    context.emit("timer", b"x")
    with pytest.raises(OverflowError, match="CommandCapacityExceeded"):
        context.emit("timer", b"y")
    assert context.commands == [(1, "timer", b"x")]


def test_request_hash_tells_requests_apart(spark):
    df = spark.createDataFrame([(1, "ab", b"c"), (1, "a", b"bc"), (2, "ab", b"c"), (1, "ab", b"c"), (1, None, None)], "d long, name string, raw binary")
    got = [r.h for r in df.select(durable.request_hash(F.col("d"), F.lit(1), F.lit(1), F.lit(1), F.col("name"), F.col("raw")).alias("h")).collect()]
    assert got[0] == got[3] and len(set(got)) == 4


def test_command_buffer_and_events(spark):
    buffer = ecs.CommandBuffer()
    made = buffer.create()
    buffer.add(made, "health", "5")
    buffer.set(3, "health", "6", 1)
    buffer.remove(4, "name", 2)
    buffer.destroy(5, 1)
    rows = buffer.frame(spark).orderBy("sequence").collect()
    assert [(r.sequence, r.kind, r.target) for r in rows] == [(1, "create", -1), (2, "add", -1), (3, "set", 3), (4, "remove", 4), (5, "destroy", 5)] and not buffer.rows
    told, event = [], ecs.ImmediateEvent()
    event.subscribe(told.append)
    event.subscribe(lambda x: told.append(x + 1))
    event.emit(1)
    assert told == [1, 2]


def test_restore_checks_everything_first(spark):
    world = spark.createDataFrame([(1, 1, 5, "a")], "entity_index long, entity_generation long, health long, name string")
    stored, now = {"health": ("long", 1), "name": ("string", 2)}, {"health": ("long", 2), "name": ("string", 2)}
    got = ecs.restore(world, stored, now, {("health", 1): lambda c: c * 10}).first()
    assert (got.health, got.name) == (50, "a")
    for a, b, steps, why in ((stored, now, {}, "MissingMigration"), (stored, {"health": ("long", 1)}, {}, "UnknownComponent"), ({"health": ("long", 1)}, {"health": ("int", 1)}, {}, "SchemaMismatch"), ({"health": ("long", 1)}, {"health": ("long", 3)}, {("health", 1): lambda c: c}, "MigrationGap")):
        with pytest.raises(ValueError, match=why):
            ecs.restore(world, a, b, steps)


def test_manifest_bytes():
    key = codecs.pack_resource_key(7, bytes(16), b"fixture", None)
    raw = codecs.pack_manifest(key, 3, "present", 9, bytes(range(16)), b"mem://fixture")
    known = {(codecs.MANIFEST_SCHEMA, codecs.MANIFEST_VERSION)}
    assert codecs.unpack_manifest(raw, 1024, known) == {"key": key, "generation": 3, "state": "present", "content_hash": 9, "producer": bytes(range(16)), "location": b"mem://fixture"}
    paged = codecs.pack_resource_key(1, bytes(16), b"f", 12)
    assert codecs.unpack_manifest(codecs.pack_manifest(paged, 0, "tombstone", None, bytes(16), b""), 1024, known)["content_hash"] is None
    with pytest.raises(codecs.FormatError, match="ChecksumMismatch"):
        codecs.unpack_manifest(raw[:-1] + bytes([raw[-1] ^ 1]), 1024, known)
    with pytest.raises(codecs.FormatError, match="UnknownSchema"):
        codecs.unpack_manifest(raw, 1024, set())
    with pytest.raises(codecs.FormatError, match="UnknownVersion"):
        codecs.unpack_manifest(codecs.seal(codecs.MANIFEST_SCHEMA, 2, b""), 1024, known)


def test_plan_of_files_and_pages(spark):
    rows = [("f", 1, 1, "write", 1, None, None), ("f", 2, 2, "write", 2, None, None), ("f", 3, 3, "read", None, None, None), ("f", 4, 4, "write", 1, 0, 10), ("f", 5, 5, "read", 1, 10, 20), ("g", 6, 6, "write", None, None, None), ("g", 7, 7, "read", 1, 1 << 60, (1 << 60) + 3), ("g", 8, 7, "write", 1, (1 << 60) + 1, (1 << 60) + 2)]
    df = spark.createDataFrame(rows, "name string, seq long, node long, mode string, page long, lo long, hi long")
    plan = resources.access_plan(df, 1 << 58)
    assert {(r.src, r.dst): (r.name, r.hazard) for r in plan.collect()} == {(1, 3): ("f", "raw"), (2, 3): ("f", "raw"), (1, 4): ("f", "waw"), (3, 4): ("f", "war"), (1, 5): ("f", "raw"), (6, 7): ("g", "raw"), (7, 7): ("g", "war")}
    assert [tuple(r) for r in resources.plan_errors(plan).collect()] == [(7, "CycleDetected")]
    assert resources.access_plan(df.limit(0), 16).count() == 0


def test_range_hazards_of_whole_accesses_alone(spark):
    df = spark.createDataFrame([("r", 1, 1, "write", None, None), ("r", 2, 2, "read", None, None), ("s", 3, 3, "read", 0, 5), ("s", 4, 4, "write", 5, 9), ("s", 5, 5, "write", None, None)], "res string, seq long, node long, mode string, lo long, hi long")
    assert {(r.src, r.dst, r.hazard) for r in resources.range_hazards(df, ["res"], 4).collect()} == {(1, 2, "raw"), (3, 5, "war"), (4, 5, "waw")}


def test_overlap_predicate(spark):
    df = spark.sql("select named_struct('lo', 1L, 'hi', 3L) a, named_struct('lo', 3L, 'hi', 5L) b, named_struct('lo', cast(null as long), 'hi', cast(null as long)) c")
    got = df.select(resources.overlap("a", "b").alias("x"), resources.overlap("a", "c").alias("y"), resources.overlap("b", "b").alias("z")).first()
    assert tuple(got) == (False, True, True)
    assert tuple(spark.range(1).select(resources.can_ever_fit({"id": 0}).alias("x")).first()) == (True,)


def test_depth_is_no_cycle(spark):
    nodes, edges = spark.range(6).withColumnRenamed("id", "node"), spark.range(5).selectExpr("id as src", "id + 1 as dst")
    with pytest.raises(dag.DepthError):
        dag.levels(nodes, edges, most=3)
    with pytest.raises(dag.CycleError):
        dag.levels(nodes, edges.union(spark.createDataFrame([(5, 0)], "src long, dst long")))


def test_numbers_over_ranges(spark):
    got = algorithms.number_global(spark.range(1000).repartition(7), [F.desc("id")], "n").collect()
    assert {r.id: r.n for r in got} == {i: 1000 - i for i in range(1000)}
    assert algorithms.number_global(spark.range(0), [F.asc("id")], "n").count() == 0
    assert [r.id for r in algorithms.sort_unstable(spark.range(5), [F.desc("id")]).collect()] == [4, 3, 2, 1, 0]


def test_long_histories_fold_in_parts(spark, monkeypatch):
    monkeypatch.setattr(workflow, "FOLDED", 10)
    table = {("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a", ("c", "y"): "z"}
    kinds = ["x", "y", "w"]
    rows = [(k, s, kinds[(s * 7 + k) % 3]) for k in range(5) for s in range(95)]
    want = {}
    for k, _, kind in rows:
        want[k] = table.get((want.get(k, "a"), kind), want.get(k, "a"))
    got = workflow.fold_states(spark.createDataFrame(rows, "k int, sequence long, kind string").repartition(4), ["k"], "sequence", "kind", table, "a").collect()
    assert {r.k: (r.state, r.events) for r in got} == {k: (s, 95) for k, s in want.items()}


def test_tenants_see_their_own(spark):
    df = spark.createDataFrame([("t", "n", 1), ("t", "m", 2), ("u", "n", 3)], "tenant string, namespace string, x int")
    assert [r.x for r in workflow.scoped(df, "t", "n", "viewer").collect()] == [1]
    with pytest.raises(PermissionError):
        workflow.scoped(df, "t", "n", "viewer", "admin")


def test_ids_and_checksums(spark):
    df = spark.createDataFrame([(4, 1), (0xFFFFFFFF, 0), (4, 2)], "i long, g long")
    assert [r.t for r in df.select(hashing.generational(F.col("i"), F.col("g")).alias("t")).collect()] == ["4:1", "invalid", "4:2"]
    logs = spark.createDataFrame([([1, 2], [7, 9]), ([], []), (None, None)], "k array<long>, t array<long>")
    h = 0xCBF29CE484222325
    for x in (1, 7, 2, 9):
        h = (h ^ x) * 0x100000001B3 % (1 << 64)
    got = [r.h % (1 << 64) for r in logs.select(hashing.replay_checksum(F.col("k"), F.col("t")).alias("h")).collect()]
    assert got == [h, 0xCBF29CE484222325, 0xCBF29CE484222325]
    assert workflow.task_id(bytes(16), 1, 2, 3) == codecs.derived_id(bytes(16), 1, 2, 3) != workflow.task_id(bytes(16), 1, 3, 2)


def test_backup_and_checked_restore(spark, tmp_path):
    table, copy = (stores.VersionedTable(spark, f"file://{tmp_path}/{n}") for n in ("a", "b"))
    table.commit(spark.createDataFrame([(1, "x"), (2, None)], "id long, v string"))
    told = table.fingerprint()
    assert table.backup(f"file://{tmp_path}/b") == 2 and copy.fingerprint() == told
    table.commit(spark.createDataFrame([(9, "y")], "id long, v string"))
    with pytest.raises(ValueError, match="SchemaMismatch"):
        table.restore(f"file://{tmp_path}/b", schema="struct<id:bigint>")
    with pytest.raises(ValueError, match="saved"):
        table.restore(f"file://{tmp_path}/b", fingerprint=("", 0, 0))
    assert table.current() == 2
    assert table.restore(f"file://{tmp_path}/b", told[0], told) == 3 and table.fingerprint() == told


def test_activities_need_a_contract():
    known = workflow.ActivityRegistry()
    known.register_activity(1, "mail", "keyed", print)
    assert known.by_name("mail") == ("keyed", print) and known.by_name("other") is None
    for args, why in (((2, "pay", "", print), "IdempotencyContractRequired"), ((2, "mail", "keyed", print), "DuplicateName"), ((1, "mail", "keyed", print), "DuplicateVersion")):
        with pytest.raises(ValueError, match=why):
            known.register_activity(*args)
    known.frozen = True
    with pytest.raises(RuntimeError, match="Frozen"):
        known.register_activity(3, "new", "keyed", print)


def against_sql(spark, folder, name):
    """Rows of a query and of its SQL over events numbered on both sides of 100,000, where arrivals of repeated results meet others'."""
    import duckdb

    import __spark_entry__ as entry

    ids = [*range(0, 40), *range(99_980, 100_040), *range(200_000, 200_040)]
    rows = [(i, i % 23, ("click", "error", "view")[i % 3 if i % 4 else 1], float(i % 500)) for i in ids]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = entry.queries()[name](spark, f"file://{folder}").select(*columns).collect()
    return sorted(map(tuple, found), key=repr), sorted(want.fetchall(), key=repr)


def test_results_of_many_activities(spark, tmp_path):
    found, want = against_sql(spark, tmp_path, "q50_finish_activities")
    assert found == want and {v for _, v, _ in found} == {"finished", "NotFound", "StaleRuntimeEpoch"}


def test_heartbeats_of_many_activities(spark, tmp_path):
    found, want = against_sql(spark, tmp_path, "q50_heartbeats")
    assert found == want and (99_985, 99_992) in found and (100_001, 100_008) in found and (200_030, 200_040) in found
