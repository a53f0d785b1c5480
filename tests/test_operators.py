import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import algorithms, dag, ecs, resources, workflow


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scans_and_reduce(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 10)], "k long, x long").repartition(3)
    assert [r[1] for r in rows(algorithms.scan_global(df, "k", "x", "s"), "k", "s")] == list(itertools.accumulate(range(1, 10)))
    assert [r[1] for r in rows(algorithms.scan_global(df, "k", "x", "s", exclusive=True), "k", "s")] == [0, 1, 3, 6, 10, 15, 21, 28, 36]
    assert [r[1] for r in rows(algorithms.scan_within(df, [], "k", "x", "s", exclusive=True, initial=10), "k", "s")][:3] == [10, 11, 13]
    words = spark.createDataFrame([(i, chr(97 + i)) for i in range(20)], "k long, x string").repartition(5)
    assert algorithms.reduce_ordered(words, "k", "x", ">", lambda a, b: a + b, 4) == ">" + "".join(chr(97 + i) for i in range(20))
    assert algorithms.reduce_ordered(words.limit(0), "k", "x", ">", lambda a, b: a + b) == ">"


def test_for_range_invoke_sort_pipeline(spark):
    df = algorithms.for_range(spark, 0, 137, lambda ids: ids.to_frame("id").assign(y=ids * 2), "id long, y long", 3)
    assert df.count() == 137 and df.agg(F.sum("y")).first()[0] == 137 * 136
    with pytest.raises(ValueError):
        algorithms.for_range(spark, 2, 1, None, "id long")
    assert algorithms.invoke([lambda: 1, lambda: 2]) == [1, 2]
    pairs = spark.createDataFrame([(i, v) for i, v in enumerate([4, 1, 3, 3, 2, 5, 0])], "i long, v long")
    assert [r.v for r in algorithms.sort_stable(pairs, [F.col("v")], "i").collect()] == [0, 1, 2, 3, 3, 4, 5]
    assert algorithms.pipeline(pairs, lambda batches: batches, "i long, v long").count() == 7


def test_query_validation_and_change(spark):
    for bad in (ecs.Query(required=("a",), write=("a", "a")), ecs.Query(write=("a",)), ecs.Query(required=("a",), read=("a", "a")), ecs.Query(required=("a",), read=("a",), write=("a",))):
        with pytest.raises(ValueError):
            bad.validate()
    world = spark.createDataFrame([(1, 1, 5, 3, None, None), (2, 1, 6, 9, 1, 9), (3, 1, None, None, 2, 1)], "entity_index long, entity_generation long, a long, a_ver long, b long, b_ver long")
    assert rows(ecs.run_query(world, ecs.Query(required=("a",), excluded=("b",))), "entity_index") == [(1,)]
    assert rows(ecs.run_query(world, ecs.Query(optional=("a", "b"), changed=("a", "b")), F.lit(4)), "entity_index") == [(2,)]
    assert rows(world.select(ecs.signature(["a", "b"]).alias("s")), "s") == [(["a"],), (["a", "b"],), (["b"],)]
    written = ecs.write_component(world, "a", F.col("a") + 1, 7)
    assert {r.entity_index: (r.a, r.a_ver) for r in written.collect()} == {1: (6, 7), 2: (7, 7), 3: (None, None)}


def serial_apply(world, commands):
    """One component, the rules in words: destroys first, then in order."""
    gone = {t for _, k, t, _ in commands if k == "destroy"}
    out = {e: v for e, v in world.items() if e not in gone}
    for _, k, t, v in sorted(commands):
        if t in out and k != "destroy":
            out[t] = None if k == "remove" else v
    return out


def test_commands_against_serial(spark):
    random.seed(4)
    for _ in range(3):
        world = {e: random.choice([None, e]) for e in range(12)}
        commands = [(i, random.choice(["add", "set", "remove", "destroy"] if i % 5 == 0 else ["add", "set", "remove"]), random.randrange(12), i * 10) for i in range(30)]
        df = spark.createDataFrame([(e, 1, v, 0) for e, v in world.items()], "entity_index long, entity_generation long, c long, c_ver long")
        batch = spark.createDataFrame([(s, k, t, "c", v) for s, k, t, v in commands], "sequence long, kind string, target long, component string, value long")
        got = {r.entity_index: r.c for r in ecs.apply_commands(df, batch, "c", 5).collect()}
        assert got == serial_apply(world, commands)


def test_invalid_commands(spark):
    world = spark.createDataFrame([(1, 1, 5), (2, 1, None)], "entity_index long, entity_generation long, c long")
    batch = spark.createDataFrame([(1, "set", 1, 1, "c"), (2, "set", 2, 1, "c"), (3, "add", 2, 1, "c"), (4, "set", 2, 1, "c"), (5, "set", 1, 9, "c"), (6, "add", 1, 1, "z")], "sequence long, kind string, target long, generation long, component string")
    assert rows(ecs.invalid(batch, world, ["c"]), "sequence", "error") == [(2, "MissingComponent"), (5, "StaleEntity"), (6, "UnknownComponent")]


def test_entities_delta_and_journal(spark):
    free = spark.createDataFrame([(3, 1, 10), (4, (1 << 32) - 1, 20)], "entity_index long, generation long, freed_at long")
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "sequence long")
    assert rows(ecs.assign_entities(wanted, free, 9), "sequence", "entity_index", "entity_generation") == [(1, 4, 1), (2, 3, 2), (3, 9, 1)]
    before = spark.createDataFrame([(1, 1, None), (2, 2, 2), (3, 3, 3)], "e long, a long, b long")
    after = spark.createDataFrame([(1, 1, 4), (2, 5, None), (4, 1, 1)], "e long, a long, b long")
    ops = ecs.delta(before, after, "e", ["a", "b"])
    assert {tuple(r) for r in ops.collect()} == {(1, "b", "add"), (2, "a", "set"), (2, "b", "remove"), (3, None, "destroy"), (4, None, "create"), (4, "a", "add"), (4, "b", "add")}
    base, target = ecs.content_hash(before, ["e", "a", "b"]), ecs.content_hash(after, ["e", "a", "b"])
    assert rows(ecs.apply_delta(before, ops, after, "e", ["a", "b"], base, target), "e") == [(1,), (2,), (4,)]
    with pytest.raises(ValueError):
        ecs.apply_delta(after, ops, after, "e", ["a", "b"], base)
    ring = ecs.RollbackRing(2)
    for n, df in ((1, before), (2, after), (3, before)):
        ring.push(n, df, ["e", "a", "b"])
    assert sorted(ring.frames) == [2, 3]
    assert ring.replay(2, lambda w, n: before, 3, ["e", "a", "b"]) is before
    with pytest.raises(ValueError, match="frame 3"):
        ring.replay(2, lambda w, n: after, 3, ["e", "a", "b"])
    assert ring.rollback(2) is after and sorted(ring.frames) == [2]
    with pytest.raises(ValueError):
        ecs.journal(before, 0)


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    levels = dag.levels(nodes, edges)
    assert rows(levels, "node", "level") == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 0)]
    assert rows(dag.unlocks(levels, edges), "node", "unlock") == [(1, 4), (2, 1), (3, 1), (4, 0), (5, 0)]
    assert rows(dag.outcomes(nodes, edges, nodes.where("node = 2")), "node", "state") == [(1, "completed"), (2, "failed"), (3, "completed"), (4, "cancelled"), (5, "completed")]
    with pytest.raises(dag.CycleError):
        dag.levels(nodes, spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_hazards(spark):
    acc = spark.createDataFrame([("r", 1, 1, "write"), ("r", 2, 2, "read"), ("r", 3, 3, "write")], "res string, seq long, node long, mode string")
    assert rows(resources.hazards(acc, ["res"]), "src", "dst", "hazard") == [(1, 2, "raw"), (1, 3, "waw"), (2, 3, "war")]
    own = spark.createDataFrame([("r", 1, 1, "write"), ("r", 2, 1, "read")], "res string, seq long, node long, mode string")
    assert resources.hazards(own, ["res"]).count() == 0
    ranged = spark.createDataFrame([("f", 1, 1, "write", 0, 10), ("f", 2, 2, "write", 20, 30), ("f", 3, 3, "read", 0, 30), ("f", 4, 4, "write", 5, 8)], "res string, seq long, node long, mode string, lo long, hi long")
    assert rows(resources.range_hazards(ranged, ["res"], 16), "src", "dst", "hazard") == [(1, 3, "raw"), (1, 4, "waw"), (2, 3, "raw"), (3, 4, "war")]


def test_overlay_against_cells(spark):
    random.seed(2)
    ranges = []
    for i in range(25):
        lo = random.randrange(60)
        ranges.append(("k", lo, lo + random.randrange(1, 20), random.choice("ab"), i))
    cells = {}
    for _, lo, hi, v, _ in ranges:
        cells.update(dict.fromkeys(range(lo, hi), v))
    want = []
    for c in sorted(cells):
        if want and want[-1][1] == c and want[-1][2] == cells[c]:
            want[-1][1] = c + 1
        else:
            want.append([c, c + 1, cells[c]])
    df = spark.createDataFrame(ranges, "k string, lo long, hi long, value string, ord long")
    assert rows(resources.overlay(df, ["k"], "ord", 16), "lo", "hi", "value") == sorted(map(tuple, want))
    pairs = resources.overlap_join(df.select("k", "lo", "hi"), df.select("k", "lo", "hi"), ["k"], 8).count()
    assert pairs == sum(a[1] < b[2] and b[1] < a[2] for a in ranges for b in ranges)


def test_budget_lru_versions(spark):
    df = spark.createDataFrame([("q", 1, 3, 1), ("q", 2, 2, 1), ("q", 3, 1, 1)], "q string, n long, memory long, disk long")
    assert rows(resources.admit(df, "q", "n", {"memory": 4, "disk": 2}), "n", "admitted") == [(1, True), (2, False), (3, True)]
    touches = spark.createDataFrame([("c", 1, "a", 4), ("c", 2, "b", 4), ("c", 3, "a", None), ("c", 4, "d", 4), ("c", 5, "e", 99)], "cache string, tick long, key string, size long")
    assert rows(resources.lru(touches, "cache", 8), "key") == [("a",), ("d",)]
    acc = spark.createDataFrame([("r", 1, "create"), ("r", 2, "create"), ("r", 3, "delete"), ("r", 4, "read")], "res string, seq long, mode string")
    assert rows(resources.lifecycle_violations(acc, ["res"], "seq", "mode"), "seq") == [(2,), (4,)]
    assert rows(resources.versions(acc, ["res"], "seq", "mode"), "generation", "state") == [(1, "present"), (2, "present"), (3, "tombstone")]


def test_login_replays(spark):
    history = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("b", 1, 1), ("b", 2, 2), ("b", 3, 20), ("b", 4, 4), ("c", 1, 1), ("c", 3, 3), ("d", 1, 1), ("d", 2, 3), ("d", 3, 2)], "w string, sequence long, kind int")
    folded = workflow.fold_with(history, ["w"], workflow.login, "idle").cache()
    assert rows(folded, "w", "sequence", "state", "status") == [
        ("a", 1, "waiting", "running"), ("a", 2, "authenticated", "completed"), ("b", 1, "waiting", "running"), ("b", 2, "waiting", "running"), ("b", 4, "timed_out", "failed"),
        ("c", 1, "waiting", "running"), ("c", 3, "waiting", "InvalidSequence"), ("d", 1, "waiting", "running"), ("d", 2, "authenticated", "completed"), ("d", 3, "authenticated", "TerminalInstance"),
    ]
    work = workflow.lower_commands(folded.where("w = 'a'"), ["w"])
    assert rows(work, "command_sequence", "kind") == [((1 << 32) + 1, "schedule_activity"), ((1 << 32) + 2, "schedule_timer"), ((1 << 32) + 3, "send_signal")]
    good = folded.where("w = 'a'")
    assert workflow.verify_replay(good, good, ["w"]).count() == 0
    assert rows(workflow.verify_replay(good, good.where("sequence = 1").withColumn("commands", F.slice("commands", 1, 1)), ["w"]), "sequence", "verdict") == [(1, "CommandMismatch"), (2, "MissingCommands")]
    assert rows(workflow.verify_replay(good, good.unionByName(good), ["w"]), "verdict") == [("DuplicateCommands",)] * 2


def test_workflow_tables(spark):
    tasks = spark.createDataFrame([(1, "ready", 5, None), (2, "claimed", 1, 1), (3, "ready", 50, None), (4, "claimed", 0, 2)], "t long, status string, available long, claimed_epoch long").withColumn("q", F.lit("q"))
    assert rows(workflow.claims(tasks, ["q"], "available", "t", F.lit(10), 2, 5), "t") == [(1,), (2,)]
    assert rows(workflow.complete(tasks, tasks.select("t"), "t", 2), "t", "verdict")[3] == (4, "completed")
    assert workflow.recover(tasks).where("status = 'claimed'").count() == 0
    steps = spark.createDataFrame([("p", 1, "pending"), ("p", 2, "pending"), ("x", 1, "pending"), ("x", 2, "failed")], "p string, i long, status string")
    assert rows(workflow.next_compensation(steps, ["p"], "i"), "p", "i") == [("p", 2)]
    definitions = spark.createDataFrame([(1, 1)], "definition_id long, definition_version long")
    blocked = spark.createDataFrame([(1, 1), (1, 2), (9, 1)], "definition_id long, definition_version long")
    assert rows(workflow.unknown_definitions(blocked, definitions), "definition_id", "reason") == [(1, "UnknownVersion"), (9, "UnknownDefinition")]
    states = spark.createDataFrame([(2, "state"), (3, "new")], "version long, state string")
    assert rows(workflow.migrate(states, {2: lambda s: s + "!"}, 3), "version", "state") == [(3, "new"), (3, "state!")]
    with pytest.raises(ValueError, match="MigrationGap"):
        workflow.migrate(states, {}, 3)
    children = spark.createDataFrame([("p", "c1", "running", 1), ("p", "c2", "running", 2), ("p", "c3", "running", 3), ("p", "c4", "completed", 3), ("o", "c5", "running", 3)], "parent_id string, child string, status string, policy int")
    parents = spark.createDataFrame([("p", "failed"), ("o", "running")], "workflow_id string, status string")
    assert rows(workflow.close_children(parents, children), "child", "action") == [("c1", "abandoned"), ("c2", "cancel_requested"), ("c3", "terminated")]
    late = spark.createDataFrame([(False, 0, None, None, 5, 9, 9), (False, 0, 1, None, 5, 3, 99), (False, 0, 8, 8, 5, 99, 1), (True, 0, None, None, 5, 9, 9), (False, 0, 9, 9, 5, 9, 9)], "cancel_requested boolean, scheduled_ms long, started_ms long, heartbeat_ms long, schedule_to_start_ms long, start_to_close_ms long, heartbeat_timeout_ms long")
    assert [r.verdict for r in workflow.activity_verdicts(late, F.lit(10)).collect()] == ["schedule_to_start_timeout", "start_to_close_timeout", "heartbeat_timeout", "cancelled", "running"]
    registry = workflow.Registry()
    registry.register(1, 3, "login", "x")
    for args, error in (((1, 3, "login", "x"), "DuplicateVersion"), ((2, 1, "login", "x"), "DuplicateName")):
        with pytest.raises(ValueError, match=error):
            registry.register(*args)
    with pytest.raises(KeyError, match="UnknownVersion"):
        registry.find(1, 9)
