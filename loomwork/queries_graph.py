"""Registered queries of entity tables, task and resource graphs beyond the first ones, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing
from .functions.hashing import fnv1a64
from .operators import algorithms, dag, ecs, resources
from .queries import ACCESS, EDGES, GRAPH, graph, query, read

#: Users are entities; a user's first event tells which components it has.
WORLD = """user_id as entity_index, 1 as entity_generation, case when user_id % 3 <> 0 then cast(user_id * 2 as bigint) end as health, cast(user_id as bigint) as health_ver,
    case when user_id % 4 <> 1 then concat('n', user_id) end as name, cast(4294967290 + user_id as bigint) % 4294967296 as name_ver"""


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "events").createOrReplaceTempView("loomwork_events")
    return spark.sql(f"select distinct {WORLD} from loomwork_events")


W = f"w as (select distinct {WORLD} from events)"


@query(f"with {W} select entity_index, health, name from w where health is not null and (name_ver - 4294967200 + 4294967296) % 4294967296 between 1 and 2147483647 and name is not null")
def q08_changed_since_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with both components whose name is newer than a cursor on the wrapping ring."""
    found = ecs.run_query(world(spark, sf_dir), ecs.Query(required=("health",), read=("name",), changed=("name",)), F.lit(4_294_967_200))
    return found.select("entity_index", "health", "name")


@query(f"with {W} select entity_index, case when health is null then null else health + 5 end as health, case when health is null then health_ver else 77 end as health_ver from w")
def q08_write_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecs.write_component(world(spark, sf_dir), "health", F.col("health") + 5, 77).select("entity_index", "health", "health_ver")


COMMANDS = """event_id as sequence, case when event_id % 211 = 0 then 'destroy' when event_type = 'view' then 'remove' when event_type = 'click' then 'add' else 'set' end as kind, user_id as target, cast(1 as int) as generation,
    case when event_id % 5 = 0 then 'name' else 'health' end as component, cast(floor(value) as bigint) as value"""


@query(f"""
    with {W}, c as (select {COMMANDS} from events where event_id < 2000), g as (select distinct target from c where kind = 'destroy'),
    l as (select target, arg_max(kind, sequence) as kind, arg_max(value, sequence) as value from c where component = 'health' and kind <> 'destroy' and target not in (select target from g) group by target)
    select entity_index, case when kind is null then health when kind = 'remove' then null else value end as health, case when kind is null then health_ver else 9 end as health_ver
    from w left join l on target = entity_index where entity_index not in (select target from g)
""")
def q10_apply_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch applied to a world: destroyed entities go, of the others each takes its last command."""
    commands = read(spark, sf_dir, "events").where("event_id < 2000").selectExpr(*_columns(COMMANDS))
    return ecs.apply_commands(world(spark, sf_dir), commands, "health", 9).select("entity_index", "health", "health_ver")


def _columns(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query(f"""
    with {W}, c as (select {COMMANDS.replace("cast(1 as int)", "cast(case when event_id % 101 = 0 then 2 else 1 end as int)")} from events),
    b as (select *, last_value(case when kind in ('add', 'set') then true when kind = 'remove' then false end ignore nulls) over (partition by target, component order by sequence rows between unbounded preceding and 1 preceding) as before from c)
    select sequence, 'UnknownComponent' as error from c where component = 'name' and kind in ('add', 'set', 'remove')
    union all select sequence, 'StaleEntity' from c where generation <> 1
    union all select sequence, 'MissingComponent' from b join w on target = entity_index where generation = 1 and kind = 'set' and not coalesce(before, case component when 'health' then health is not null else false end)
""")
def q09_invalid_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops a batch: names aren't registered here, and some targets are older entities."""
    commands = read(spark, sf_dir, "events").selectExpr(*_columns(COMMANDS.replace("cast(1 as int)", "cast(case when event_id % 101 = 0 then 2 else 1 end as int)")))
    return ecs.invalid(commands, world(spark, sf_dir), ["health"])


@query(f"""
    with {W} select entity_index, 'added' as what, 5000 + entity_index as health from w where entity_index % 7 = 0 union all select entity_index, 'removed', case when entity_index % 7 <> 1 then health end from w where entity_index % 7 <> 0
""")
def q09_add_remove_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = world(spark, sf_dir)
    added = ecs.add_components(now, now.where("entity_index % 7 = 0").selectExpr("entity_index", "5000 + entity_index as value"), "health", 3)
    both = ecs.remove_components(added, now.where("entity_index % 7 = 1").select("entity_index"), "health", 4)
    return both.selectExpr("entity_index", "case when entity_index % 7 = 0 then 'added' else 'removed' end as what", "health")


SIGNATURE = "".join(f" || case when {c} is null then '' else '{fnv1a64(c.encode()):016x}' end" for c in sorted(("health", "name"), key=lambda c: fnv1a64(c.encode())))


@query(f"""
    with {W}, s as (select entity_index, ''{SIGNATURE} as signature from w), r as (select *, dense_rank() over (order by signature) - 1 as archetype, row_number() over (partition by signature order by entity_index) - 1 as n from s)
    select entity_index, archetype, n // 16 as chunk, n % 16 as row, row_number() over (order by signature, entity_index) as place from r
""")
def q12_canonical_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a snapshot in canonical order, in chunks of sixteen."""
    return ecs.canonical(world(spark, sf_dir), ["health", "name"], 16).select("entity_index", "archetype", "chunk", "row", "place")


@query(f"with {W}, f as (select entity_index as i, row_number() over (order by health_ver desc, entity_index) as n from w where entity_index % 2 = 0), c as (select event_id as sequence, row_number() over (order by event_id) as n from events) select sequence, coalesce(i, 1000 + c.n - 1 - (select count(*) from f)) as entity_index, case when i is null then 1 else 2 end::bigint as entity_generation from c left join f on c.n = f.n")
def q12_assign_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of a batch's creations: free ones, latest first, then new ones."""
    free = world(spark, sf_dir).where("entity_index % 2 = 0").selectExpr("entity_index", "cast(entity_generation as long) as generation", "health_ver as freed_at")
    made = ecs.assign_entities(read(spark, sf_dir, "events").selectExpr("event_id as sequence"), free, 1000)
    return made.selectExpr("sequence", "cast(entity_index as long) as entity_index", "cast(entity_generation as long) as entity_generation")


@query(f"""
    with recursive {GRAPH}, w as (select node, 0 as level from v where node not in (select dst from e) union all select dst, level + 1 from w join e on src = node), l as (select node, max(level) as level from w group by node),
    c as (select dst as node from e where src = 'r2' union select e.dst from (select dst as node from e where src = 'r2') x join e on e.src = x.node), s as (select l.*, case when node = 'r2' then 'failed' when node in (select node from c) then 'cancelled' else 'completed' end as state from l),
    k as (select * from (values ('ready', 0), ('enqueued', 1), ('started', 2)) t(kind, i))
    select node, kind, level * 5 + i as step from s, k where state <> 'cancelled' union all select node, case when state = 'completed' then 'finished' else 'cancelled' end, level * 5 + 3 from s
    union all select dst, 'dependency_released', level * 5 + 4 from s join e on src = node where state = 'completed'
""")
def q16_dag_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run tells of its nodes after one region failed."""
    nodes, edges = graph(spark, sf_dir)
    return dag.trace(dag.levels(nodes, edges), edges, dag.outcomes(nodes, edges, nodes.where("node = 'r2'")))


@query(f"with e as ({EDGES}), n as (select distinct 'p' || l_partkey as node, case when l_partkey % 7 = 0 then 'gone' when l_partkey % 2 = 0 then 'compute' else 'blocking' end as target from lineitem) select node, 'UnboundTarget' as error from n where target = 'gone' union all select distinct dst, 'InvalidNodeId' from e")
def q14_graph_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are nodes, suppliers aren't."""
    items = read(spark, sf_dir, "lineitem")
    nodes = items.selectExpr("concat('p', l_partkey) as node", "case when l_partkey % 7 = 0 then 'gone' when l_partkey % 2 = 0 then 'compute' else 'blocking' end as target").distinct()
    return dag.graph_errors(nodes, items.selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst"), ["compute", "blocking"])


#: Accesses of users to ranges of a few resources; every ninth is to the whole.
RANGED = f"user_id % 40 as resource, event_id as seq, event_id as node, {ACCESS} as mode, case when event_id % 9 <> 0 then event_id % 50 * 4000000000000000 end as lo, case when event_id % 9 <> 0 then (event_id % 50 + 1 + event_id % 3) * 4000000000000000 end as hi"
#: SQL: pairs that meet and of which one writes, less those with a write between that covers what they share, stretch by stretch.
STRETCHES = """
    b as (select resource, lo as pos from a where lo is not null union select resource, hi from a where hi is not null), s as (select resource, pos, lead(pos) over (partition by resource order by pos) as upto from b),
    p as (select a.resource, seq, node, mode, pos from a join s on a.resource = s.resource and upto is not null and (lo is null or lo <= pos and pos < hi) union all select resource, seq, node, mode, -1 from a where lo is null),
    x as (select *, mode <> 'read' as w, coalesce(sum((mode <> 'read')::int) over q, 0) as epoch, max(case when mode <> 'read' then node end) over q as last from p window q as (partition by resource, pos order by seq rows between unbounded preceding and 1 preceding)),
    h as (select resource, last as src, node as dst, case when w then 'waw' else 'raw' end as hazard, case when w then 1 else 0 end as r from x where last is not null
        union all select r.resource, r.node, t.node, 'war', 2 from x r join x t on r.resource = t.resource and r.pos = t.pos and r.epoch = t.epoch and not r.w and t.w)
"""


@query(f"with a as (select {RANGED} from events where event_id < 1500), {STRETCHES} select resource, src, dst, min_by(hazard, r) as hazard from h where src <> dst group by all")
def q17_range_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazards of accesses to overlapping ranges and to whole resources; borders lie far beyond 2**53."""
    accesses = read(spark, sf_dir, "events").where("event_id < 1500").selectExpr(*_columns(RANGED))
    return resources.range_hazards(accesses, ["resource"], 16_000_000_000_000_000)


#: Accesses to files, pages of files and ranges of pages; a node declares two.
PAGED = f"concat('f', user_id % 12) as name, event_id as seq, event_id // 2 as node, {ACCESS} as mode, case when event_id % 11 <> 0 then event_id % 3 end as page, case when event_id % 11 <> 0 and event_id % 4 <> 0 then event_id % 20 * 100 end as lo, case when event_id % 11 <> 0 and event_id % 4 <> 0 then (event_id % 20 + 1 + event_id % 3) * 100 end as hi"
PLAN = f"""
    with a as (select {PAGED} from events where event_id < 1200), b as (select name, page, lo as pos from a where lo is not null union select name, page, hi from a where hi is not null),
    s as (select * from (select name, page, pos, lead(pos) over (partition by name, page order by pos) as upto from b) where upto is not null union all select distinct name, page, -1, -1 from a where page is not null),
    p as (select a.name, seq, node, mode, s.page, pos from a join s on a.name = s.name and (a.page is null or a.page = s.page and (lo is null or lo <= pos and pos < hi)) union all select name, seq, node, mode, -1, -1 from a where page is null),
    x as (select *, mode <> 'read' as w, coalesce(sum((mode <> 'read')::int) over q, 0) as epoch, arg_max(case when mode <> 'read' then node end, case when mode <> 'read' then seq end) over q as last from p window q as (partition by name, page, pos order by seq rows between unbounded preceding and 1 preceding)),
    h as (select name, last as src, node as dst, case when w then 'waw' else 'raw' end as hazard, seq * 10 + case when w then 1 else 0 end as r from x where last is not null
        union all select r.name, r.node, t.node, 'war', t.seq * 10 + 2 from x r join x t on r.name = t.name and r.page = t.page and r.pos = t.pos and r.epoch = t.epoch and not r.w and t.w),
    m as (select src, dst, arg_min(struct_pack(n := name, h := hazard), struct_pack(r := r, n := name)) as best from h group by all)
"""


def access_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = read(spark, sf_dir, "events").where("event_id < 1200").selectExpr(*_columns(PAGED.replace("event_id // 2", "event_id div 2")))
    return resources.access_plan(accesses, 400)


@query(f"{PLAN} select src, dst, best.n as name, best.h as hazard from m")
def q17_access_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of accesses to files, pages and ranges, files being barriers for their pages."""
    return access_plan(spark, sf_dir)


@query(f"{PLAN} select src as node, 'CycleDetected' as error from m where src = dst")
def q17_plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.plan_errors(access_plan(spark, sf_dir))


DECLARED = """event_id, case event_id % 8 when 0 then 'file' when 1 then 'page' when 2 then 'memory_buffer' when 3 then 'texture' else 'custom' end as kind, case event_type when 'signup' then 'create' when 'click' then 'read' else 'write' end as mode,
    case when event_id % 5 = 0 then 'must_not_exist' else 'any' end as must, event_id % 7 as lo, event_id % 4 + 2 as hi, case when event_id % 6 = 0 then event_id end as page, case when event_id % 10 = 3 then 'texture' when event_id % 10 < 6 then 'bytes' else 'whole' end as shape"""


@query(f"with d as (select {DECLARED} from events) select event_id, case when (mode = 'create') <> (must = 'must_not_exist') then 'InvalidConstraint' when shape = 'bytes' and lo >= hi then 'InvalidRange' when page is not null and kind not in ('file', 'page') then 'InvalidRange' when shape = 'texture' then 'UnsupportedRange' end as error from d")
def q20_access_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = read(spark, sf_dir, "events").selectExpr(*_columns(DECLARED))
    return declared.select("event_id", resources.access_error(F.col("kind"), F.col("mode"), F.col("must"), F.col("lo"), F.col("hi"), F.col("page"), F.col("shape")).alias("error"))


@query(f"""
    with v as (select user_id, row_number() over (partition by user_id order by event_id) as generation, {ACCESS} as mode, event_id, cast(floor(value) as bigint) % 3 as h from events where {ACCESS} <> 'read'),
    c as (select user_id, max_by(generation, event_id) as generation, max_by(mode, event_id) <> 'delete' as there, max_by(h, event_id) as h from v group by user_id), u as (select distinct user_id from events where user_id % 10 <> 9),
    k as (select * from (values ('any', 0), ('must_not_exist', 0), ('exact', 1), ('generation', 50), ('other', 0)) t(must, expected))
    select u.user_id, must, case when case must when 'any' then true when 'must_not_exist' then not coalesce(there, false) when 'exact' then coalesce(there and h = expected, false) when 'generation' then coalesce(there and generation = expected, false) else false end then 'ok' else 'VersionMismatch' end as verdict
    from u cross join k left join (select * from c where user_id % 10 <> 8) c on u.user_id = c.user_id
""")
def q20_all_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of constraint against each resource's version; some resources have none."""
    accesses = read(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{ACCESS} as mode", "cast(floor(value) as bigint) % 3 as h")
    made = resources.versions(accesses, ["user_id"], "event_id", "mode")
    current = made.groupBy("user_id").agg(F.max_by(F.struct("generation", "state", "h"), "event_id").alias("v")).selectExpr("user_id", "cast(v.generation as long) as generation", "v.state as state", "v.h as content_hash").where("user_id % 10 <> 8")
    kinds = F.array(*(F.struct(F.lit(k).alias("constraint"), F.lit(x).cast("long").alias("expected")) for k, x in (("any", 0), ("must_not_exist", 0), ("exact", 1), ("generation", 50), ("other", 0))))
    wanted = accesses.where("user_id % 10 <> 9").select("user_id").distinct().select("user_id", F.inline(kinds))
    return resources.constraint_check(wanted, current, ["user_id"]).select("user_id", F.col("constraint").alias("must"), "verdict")


@query("""
    with f as (select doc_id, printf('%016x', octet_length(encode(lang))) || hex(encode(lang)) || '00000003' || printf('%016x', octet_length(encode(source))) || hex(encode(source)) || printf('%016x', 2) || printf('%016x', doc_id) || printf('%016x', n_chars)
        || printf('%016x', 7) || printf('%016x', doc_id + 1) || printf('%016x', 3) || hex(encode('gcc')) || printf('%016x', 4) || hex(encode('HOME')) || printf('%016x', octet_length(encode(source))) || hex(encode(source)) || printf('%016x', 4) || hex(encode('LANG')) || printf('%016x', octet_length(encode(lang))) || hex(encode(lang)) as raw from documents)
    select doc_id, sha256(unhex(raw)) as fingerprint from f
""")
def q24_task_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's cache key: kind, version, parameters, two inputs, toolchain and two settings."""
    inputs = [(F.col("doc_id"), F.col("n_chars")), (F.lit(7), F.col("doc_id") + 1)]
    made = hashing.fingerprint(F.col("lang"), F.lit(3), F.col("source"), inputs, F.lit("gcc"), [("HOME", F.col("source")), ("LANG", F.col("lang"))])
    return read(spark, sf_dir, "documents").select("doc_id", made.alias("fingerprint"))


@query("""
    with n as (select *, lag(event_id) over w as prev, lag(event_type) over w as ptype, row_number() over w as rn from events window w as (partition by user_id order by event_id)),
    e as (select prev as src, event_id as dst from n where prev is not null union all select event_id, event_id + 3 from events where event_id % 17 = 0), o as (select src, count(*) as c, min(dst) as d from e group by src), i as (select dst, count(*) as c from e group by dst),
    g as (select n.*, case when ptype = event_type and event_type in ('click', 'view', 'error') and o.c = 1 and i.c = 1 and o.d = event_id then 0 else 1 end as new from n left join o on o.src = prev left join i on i.dst = event_id),
    r as (select *, sum(new) over (partition by user_id order by event_id) as grp from g)
    select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) as members from r group by user_id, event_type, grp
""")
def q25_fusion_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of one kind that has a proof, without a branch at an inner edge."""
    nodes = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    nodes.createOrReplaceTempView("loomwork_nodes")
    edges = spark.sql("select src, dst from (select lag(event_id) over (partition by user_id order by event_id) as src, event_id as dst from loomwork_nodes) where src is not null union all select event_id, event_id + 3 from loomwork_nodes where event_id % 17 = 0")
    proofs = spark.createDataFrame([("click", "pure"), ("view", "pure"), ("error", "x"), ("signup", "")], "kind string, proof string")
    return resources.fusion_groups(nodes, ["user_id"], "event_id", "event_type", proofs, edges)


@query("""
    with s as (select event_type, list(value order by value) as v from events group by event_type) select event_type, p, v[least(len(v) - 1, len(v) * p // 100) + 1] as value from s, (values (50), (95), (99), (100)) t(p)
""")
def q44_percentile_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = read(spark, sf_dir, "events").select("event_type", "value")
    out = None
    for p in (50, 95, 99, 100):
        some = algorithms.percentile_pick(values, ["event_type"], "value", p).select("event_type", F.lit(p).alias("p"), "value")
        out = some if out is None else out.unionByName(some)
    return out


@query("""
    with l as (select user_id, list_concat([14695981039346656037::hugeint], flatten(list([length(event_type)::hugeint, event_id::hugeint] order by event_id))) as log from events group by user_id),
    h as (select user_id, list_reduce(log, lambda a, b: xor(a, b) * 1099511628211 % 18446744073709551616) as v from l)
    select user_id, (case when v >= 9223372036854775808 then v - 18446744073709551616 else v end)::bigint as checksum from h
""")
def q39_replay_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of each user's ordered log."""
    log = F.array_sort(F.collect_list(F.struct("event_id", F.length("event_type").alias("kind"))))
    logs = read(spark, sf_dir, "events").groupBy("user_id").agg(log.alias("l"))
    return logs.select("user_id", hashing.replay_checksum(F.transform("l", lambda e: e["kind"]), F.transform("l", lambda e: e["event_id"])).alias("checksum"))


@query("select event_id, case when event_id % 100 = 0 then 'invalid' else (event_id % 50) || ':' || (event_id % 7) end as id, row_number() over (order by case when event_id % 100 = 0 then 4294967295 else event_id % 50 end, event_id % 7, event_id) as place from events")
def q39_generational_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 100 = 0 then 4294967295 else event_id % 50 end as i", "event_id % 7 as g")
    placed = algorithms.number_global(ids, [hashing.generational_order(F.col("i"), F.col("g")).asc(), F.asc("event_id")], "place")
    return placed.select("event_id", hashing.generational(F.col("i"), F.col("g")).alias("id"), "place")
