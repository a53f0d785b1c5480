"""The registered queries of the orchestration operators, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing, scalars
from .operators import algorithms, dag, ecs, resources, workflow
from .session import shared_root
from .sources import archives
from .streaming import queues

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function's name."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cents(column: str) -> F.Column:
    return F.floor(F.col(column) * 100).cast("long")


@query("""
    select d.doc_id, d.lang, d.n_chars, l.quality from documents d left join labels l on d.doc_id = l.doc_id
    where d.doc_id in (select doc_id from labels where quality is not null) and d.doc_id not in (select doc_id from labels where toxic = 1)
""")
def q01_ecs_query_required_excluded_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return ecs.relational_query(docs, "doc_id", [labels.where("quality is not null").select("doc_id")], [labels.where("toxic = 1").select("doc_id")], [labels.select("doc_id", "quality")])


@query("select count(*) as n, cast(sum(cast(floor(o_totalprice * 100) as bigint)) as bigint) as total, min(o_totalprice) as least, max(o_totalprice) as most, bit_xor(o_orderkey) as mixed from orders")
def q02_reduce_sum_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return algorithms.reduce_builtin(orders, n=F.count("*"), total=F.sum(cents("o_totalprice")), least=F.min("o_totalprice"), most=F.max("o_totalprice"), mixed=F.bit_xor("o_orderkey"))


@query("select event_id, cast(sum(cast(floor(value * 100) as bigint)) over (order by event_id) as bigint) as running from events")
def q03_scan_inclusive_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", cents("value").alias("x"))
    return algorithms.scan_global(events, "event_id", "x", "running").select("event_id", "running")


@query("select event_id, user_id, cast(coalesce(sum(cast(floor(value * 100) as bigint)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) + 7 as bigint) as before from events")
def q04_scan_exclusive_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", cents("value").alias("x"))
    return algorithms.scan_within(events, ["user_id"], "event_id", "x", "before", exclusive=True, initial=7).drop("x")


@query("select * from (select o_orderkey, o_orderpriority, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders) where place <= 20")
def q05_sort_stable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dearest orders of each priority, ties in key order."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return algorithms.sort_stable(orders.withColumn("place", place).where("place <= 20"), [F.col("o_orderpriority"), F.col("place")], "o_orderkey")


@query("""
    with r as (select max(l_orderkey) + 1 as n from lineitem), g as (select greatest(1, (n + 63) // 64) as grain from r)
    select l_orderkey // grain as chunk, min(l_orderkey) as first_key, max(l_orderkey) as last_key, count(*) as n from lineitem, g group by l_orderkey // grain
""")
def q06_range_chunk_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey")
    last = items.agg(F.max("l_orderkey")).first()[0]
    chunks = scalars.chunk_geometry((last or 0) + 1, 8)
    size = chunks[0][1] - chunks[0][0]
    chunk = F.floor(F.col("l_orderkey") / size).alias("chunk")
    return items.groupBy(chunk).agg(F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"), F.count("*").alias("n"))


@query("select event_type, case when value <= 10 then 0 when value <= 50 then 1 when value <= 100 then 2 when value <= 250 then 3 else 4 end as place, count(*) as n from events group by all")
def q07_histogram_fixed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scalars.histogram_place(F.col("value"), [10, 50, 100, 250])
    return read(spark, sf_dir, "events").groupBy("event_type", place.alias("place")).agg(F.count("*").alias("n"))


@query("select event_id from events where ((event_id * 2654435761) % 4294967296 - 4000000000 + 4294967296) % 4294967296 between 1 and 2147483647")
def q08_changed_since_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = F.pmod(F.col("event_id") * 2654435761, F.lit(1 << 32))
    return read(spark, sf_dir, "events").where(scalars.is_newer(tick, F.lit(4_000_000_000))).select("event_id")


COMMAND = "case event_type when 'signup' then 'create' when 'error' then 'destroy' else 'set' end"


@query(f"""
    with c as (select event_id as sequence, user_id as target, {COMMAND} as kind from events),
    d as (select target, min(sequence) as first from c where kind = 'destroy' group by target)
    select sequence, c.target, kind from c left join d on c.target = d.target where first is null or first = sequence
""")
def q09_command_normalize_destroy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecs.normalize(read(spark, sf_dir, "events").selectExpr("event_id as sequence", "user_id as target", f"{COMMAND} as kind"))


@query("select user_id, event_type as component, max_by(value, event_id) as value, max_by(case when value > 100 then 'set' else 'add' end, event_id) as kind from events group by all")
def q10_command_apply_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = read(spark, sf_dir, "events").selectExpr("event_id as sequence", "user_id", "event_type as component", "case when value > 100 then 'set' else 'add' end as kind", "value")
    return ecs.last_writes(commands, ["user_id", "component"])


@query("select event_id as sequence, cast(cast(ts as date) as varchar) as frame, row_number() over (partition by cast(ts as date) order by event_id) as place from events")
def q11_frame_events_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").selectExpr("event_id as sequence", "cast(to_date(ts) as string) as frame", "event_type")
    return ecs.frame_events(events.where("event_type = 'error'"), events.where("event_type <> 'error'")).select("sequence", "frame", "place")


BEFORE = "select doc_id, lang, source from documents where source <> 'src1'"
AFTER = "select doc_id, case when n_chars > 2000 then null else lang end as lang, case when lang = 'fr' then 'moved' else source end as source from documents where source <> 'src2'"


@query(f"""
    with b as ({BEFORE}), a as ({AFTER}), j as (select coalesce(b.doc_id, a.doc_id) as doc_id, b.doc_id is null as made, a.doc_id is null as gone, b.lang as l0, a.lang as l1, b.source as s0, a.source as s1 from b full join a on b.doc_id = a.doc_id),
    c as (select doc_id, gone, 'lang' as component, l0 as x, l1 as y from j union all select doc_id, gone, 'source', s0, s1 from j)
    select doc_id, null as component, case when made then 'create' else 'destroy' end as op from j where made or gone
    union all select doc_id, component, case when x is null then 'add' when y is null then 'remove' else 'set' end from c where not gone and x is distinct from y
""")
def q12_snapshot_delta_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    after = docs.where("source <> 'src2'").selectExpr("doc_id", "case when n_chars > 2000 then null else lang end as lang", "case when lang = 'fr' then 'moved' else source end as source")
    return ecs.delta(docs.where("source <> 'src1'").select("doc_id", "lang", "source"), after, "doc_id", ["lang", "source"])


@query("""
    select user_id, event_id as number, value is not null and (event_type <> 'click' or octet_length(encode(props)) <> 0) and event_type <> 'purchase' as replayable
    from events qualify row_number() over (partition by user_id order by event_id desc) <= 5
""")
def q13_journal_last_n_replayable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's journal keeps five frames; purchases lack the network input that they need."""
    frames = read(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id as number", "value as random_seed", "cast(props as binary) as input", "cast('' as binary) as network", "cast('' as binary) as external",
        "event_type = 'click' as require_input", "event_type = 'purchase' as require_network", "false as require_external",
    )
    return ecs.journal(frames, 5, ["user_id"]).select("user_id", "number", "replayable")


EDGES = "select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem"


@query(f"with e as ({EDGES}), x as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) select node, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out from x group by node")
def q14_dag_edge_dedup_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst")
    return dag.degrees(dag.distinct_edges(items))


GRAPH = """
    e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier),
    v as (select 'r' || r_regionkey as node from region union all select 'n' || n_nationkey from nation union all select 's' || s_suppkey from supplier)
"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from regions over nations to suppliers."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    nodes = region.selectExpr("concat('r', r_regionkey) as node").unionByName(nation.selectExpr("concat('n', n_nationkey) as node")).unionByName(supplier.selectExpr("concat('s', s_suppkey) as node"))
    edges = nation.selectExpr("concat('r', n_regionkey) as src", "concat('n', n_nationkey) as dst").unionByName(supplier.selectExpr("concat('n', s_nationkey) as src", "concat('s', s_suppkey) as dst"))
    return nodes, edges


@query(f"with recursive {GRAPH}, w as (select node, 0 as level from v where node not in (select dst from e) union all select dst, level + 1 from w join e on src = node) select node, max(level) as level from w group by node")
def q15_dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dag.levels(*graph(spark, sf_dir))


@query(f"""
    with recursive {GRAPH}, w as (select dst as node from e where src = 'r2' union select dst from w join e on src = node)
    select node, case when node = 'r2' then 'failed' when node in (select node from w) then 'cancelled' else 'completed' end as state from v
""")
def q16_dag_failure_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return dag.outcomes(nodes, edges, nodes.where("node = 'r2'"))


ACCESS = "case when event_type in ('click', 'view') then 'read' when event_type = 'signup' then 'create' when event_type = 'error' then 'delete' else 'write' end"


@query(f"""
    with a as (select user_id, event_id, {ACCESS} <> 'read' as w from events),
    x as (select *, coalesce(sum(w::int) over p, 0) as epoch, max(case when w then event_id end) over p as last from a window p as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
    select user_id, last as src, event_id as dst, case when w then 'waw' else 'raw' end as hazard from x where last is not null
    union all select r.user_id, r.event_id, t.event_id, 'war' from x r join x t on r.user_id = t.user_id and r.epoch = t.epoch and not r.w and t.w
""")
def q17_hazard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = read(spark, sf_dir, "events").selectExpr("user_id", "event_id as seq", "event_id as node", f"{ACCESS} as mode")
    return resources.hazards(accesses, ["user_id"])


SHIPPED = "l_partkey, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as lo, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) + cast(floor(l_quantity) as bigint) as hi"


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranges of days per part."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    return read(spark, sf_dir, "lineitem").withColumn("lo", day).withColumn("hi", F.col("lo") + F.floor("l_quantity"))


@query(f"with r as (select {SHIPPED} from lineitem) select a.l_partkey, count(*) as pairs, cast(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) as bigint) as shared from r a join r b on a.l_partkey = b.l_partkey and a.lo < b.hi and b.lo < a.hi group by a.l_partkey")
def q18_interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = shipped(spark, sf_dir).select("l_partkey", "lo", "hi")
    met = resources.overlap_join(ranges, ranges, ["l_partkey"], 64)
    return met.groupBy("l_partkey").agg(F.count("*").alias("pairs"), F.sum(F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")).alias("shared"))


@query(f"""
    with r as (select {SHIPPED}, l_returnflag as value, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) as ord from lineitem),
    p as (select l_partkey, lo as pos from r union select l_partkey, hi from r), c as (select *, lead(pos) over (partition by l_partkey order by pos) as upto from p),
    t as (select c.l_partkey, pos, upto, max_by(value, ord) as value from c join r on c.l_partkey = r.l_partkey and lo <= pos and pos < hi where upto is not null group by all),
    n as (select *, case when lag(upto) over w = pos and lag(value) over w = value then 0 else 1 end as new from t window w as (partition by l_partkey order by pos)),
    i as (select *, sum(new) over (partition by l_partkey order by pos) as island from n)
    select l_partkey, min(pos) as lo, max(upto) as hi, min(value) as value from i group by l_partkey, island
""")
def q19_interval_overlay_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"))
    ranges = shipped(spark, sf_dir).select("l_partkey", "lo", "hi", F.col("l_returnflag").alias("value"), order.alias("ord"))
    return resources.overlay(ranges, ["l_partkey"], "ord", 64)


@query(f"""
    with a as (select event_id, user_id, {ACCESS} as mode from events),
    s as (select *, lag(case when mode = 'delete' then 'absent' else 'present' end) over (partition by user_id order by event_id) as state from a)
    select event_id, user_id, mode from s where mode = 'create' and state = 'present' or mode <> 'create' and state = 'absent'
""")
def q20_lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = read(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{ACCESS} as mode")
    return resources.lifecycle_violations(accesses, ["user_id"], "event_id", "mode")


@query(f"""
    with a as (select event_id, user_id, {ACCESS} as mode from events), v as (select *, row_number() over (partition by user_id order by event_id) as generation from a where mode <> 'read'),
    c as (select user_id, max_by(generation, event_id) as generation, max_by(mode, event_id) as mode from v group by user_id)
    select a.user_id, case when mode <> 'delete' and generation = 4 then 'ok' else 'VersionMismatch' end as verdict from (select distinct user_id from events) a left join c on a.user_id = c.user_id
""")
def q20_version_constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = read(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{ACCESS} as mode")
    made = resources.versions(accesses, ["user_id"], "event_id", "mode")
    current = made.groupBy("user_id").agg(F.max_by(F.struct("generation", "state"), "event_id").alias("v")).selectExpr("user_id", "v.generation as generation", "v.state as state", "cast(null as long) as content_hash")
    wanted = accesses.select("user_id").distinct().withColumns({"constraint": F.lit("generation"), "expected": F.lit(4)})
    return resources.constraint_check(wanted, current, ["user_id"]).select("user_id", "verdict")


@query("""
    with f as (select o_custkey, list(o_orderkey order by o_orderkey) as keys, list_reduce(
        list_prepend({'m': 0::bigint, 'd': 0::bigint, 'ok': []::boolean[]}, list({'m': cast(floor(o_totalprice) as bigint), 'd': 1::bigint, 'ok': []::boolean[]} order by o_orderkey)),
        lambda a, x: case when a.m + x.m <= 500000 and a.d + x.d <= 4 then {'m': a.m + x.m, 'd': a.d + x.d, 'ok': list_append(a.ok, true)} else {'m': a.m, 'd': a.d, 'ok': list_append(a.ok, false)} end) as r
        from orders group by o_custkey)
    select o_custkey, unnest(keys) as o_orderkey, unnest(r.ok) as admitted from f
""")
def q21_budget_admission_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("memory"), F.lit(1).cast("long").alias("disk"))
    return resources.admit(wanted, "o_custkey", "o_orderkey", {"memory": 500_000, "disk": 4}).select("o_custkey", "o_orderkey", "admitted")


@query(f"""
    with recursive {GRAPH}, w as (select src, dst from e union all select w.src, e.dst from w join e on e.src = w.dst),
    u as (select node, count(w.dst) as unlock, length(node) as mean_ns from v left join w on w.src = node group by node)
    select node, unlock, mean_ns, row_number() over (order by unlock desc, mean_ns desc, node) as place from u
""")
def q22_ready_order_by_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    score = dag.unlocks(dag.levels(nodes, edges), edges)
    return resources.ready_order(score.withColumn("mean_ns", F.length("node").cast("long")))


@query("select user_id, list_reduce(list(cast(floor(value * 1000) as bigint) order by event_id), lambda a, x: (a * 7 + x) // 8) as mean from events group by user_id")
def q23_ewma_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.floor(F.col("value") * 1000).cast("long").alias("x")))), lambda s: s["x"])
    return read(spark, sf_dir, "events").groupBy("user_id").agg(samples.alias("s")).select("user_id", scalars.moving_mean(F.col("s")).alias("mean"))


@query("select doc_id, sha256(unhex(printf('%016x', octet_length(encode(text)))) || encode(text)) as fingerprint from documents")
def q24_fingerprint_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(hashing.framed("text"), 256).alias("fingerprint"))


@query("""
    with n as (select *, case when lag(event_type) over (partition by user_id order by event_id) = event_type then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by event_id) as grp from n)
    select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) as members from g group by user_id, event_type, grp
""")
def q25_fusion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.fusion_groups(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("select event_id, user_id, case when row_number() over w = 1 then 'started' when event_type = first(event_type) over w then 'existing' else 'IdempotencyConflict' end as outcome from events window w as (partition by user_id order by event_id)")
def q26_idempotent_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.starts(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type").drop("event_type")


@query("""
    with f as (select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type)
    select event_id, user_id, event_type, 2 + row_number() over (partition by user_id order by event_id) - 1 as sequence from f
""")
def q27_inbox_dedup_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.inbox(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id", F.lit(2))


@query("""
    with t as (select event_id, event_type, cast(floor(value) as bigint) as available, case when value > 100 then 'ready' else 'claimed' end as status, case when user_id < 50 then 1 else 3 end as epoch from events)
    select event_id, event_type, available from t where status = 'ready' and available <= 400 or status = 'claimed' and epoch < 3 qualify row_number() over (partition by event_type order by available, event_id) <= 3
""")
def q28_claim_top1_per_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three tasks of each queue."""
    tasks = read(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(floor(value) as bigint) as available", "case when value > 100 then 'ready' else 'claimed' end as status", "case when user_id < 50 then 1 else 3 end as claimed_epoch")
    return workflow.claims(tasks, ["event_type"], "available", "event_id", F.lit(400), 3, 3).select("event_id", "event_type", "available")


MACHINE = {("new", "signup"): "active", ("new", "view"): "guest", ("guest", "signup"): "active", ("active", "purchase"): "paying", ("active", "error"): "failed", ("paying", "error"): "failed", ("failed", "view"): "active"}


@query(
    "select user_id, list_reduce(list_prepend('new', list(event_type order by event_id)), lambda s, x: case "
    + " ".join(f"when s = '{a}' and x = '{k}' then '{b}'" for (a, k), b in MACHINE.items())
    + " else s end) as state, count(*) as events from events group by user_id"
)
def q29_state_machine_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return workflow.fold_states(events, ["user_id"], "event_id", "event_type", MACHINE, "new")


@query("""
    with a as (select event_id, 1 + event_id % 7 as attempt, event_id * 31 as seed, event_type from events), d as (select *, least(5000, 100 * cast(pow(2, least(attempt - 1, 6)) as bigint)) as delay from a)
    select event_id, delay - delay // 100 * 20 + seed % (delay // 100 * 20 * 2 + 1) as delay_ms, attempt < 5 and event_type <> 'error' as retry from d
""")
def q30_retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt, kind = F.col("event_id") % 7 + 1, F.when(F.col("event_type") == "error", "non_retryable").otherwise("application")
    return read(spark, sf_dir, "events").select("event_id", scalars.backoff_ms(attempt, F.col("event_id") * 31, 100, 5000, 20).alias("delay_ms"), scalars.should_retry(attempt, kind, F.lit(1), 5, [9]).alias("retry"))


@query("select timer_id, queue from (select event_id as timer_id, event_type as queue, row_number() over (partition by event_type order by ts, event_id) as r from events where value > 50 and ts <= timestamp '2024-01-15 00:00:00') where r <= 2")
def q31_due_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two timers of each queue that fire next."""
    timers = read(spark, sf_dir, "events").selectExpr("event_id as timer_id", "event_type as queue", "ts as fire_at", "case when value > 50 then 'scheduled' else 'done' end as status")
    return workflow.due_timers(timers, ["queue"], F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 2).select("timer_id", "queue")


STEP = "case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'failed' end"


@query(f"with s as (select o_custkey, o_orderkey, {STEP} as status from orders) select o_custkey, max(o_orderkey) filter (status = 'pending') as step from s group by o_custkey having count(*) filter (status = 'failed') = 0 and count(*) filter (status = 'pending') > 0")
def q32_compensation_reverse_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey as step", f"{STEP} as status")
    return workflow.next_compensation(steps, ["o_custkey"], "step").select("o_custkey", "step")


@query("select l_orderkey, min(l_linenumber) as first, max(l_linenumber) as last, count(*) as events from lineitem group by l_orderkey having max(l_linenumber) - min(l_linenumber) + 1 <> count(*) or count(distinct l_linenumber) <> count(*)")
def q33_health_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.gaps(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def q33_health_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return workflow.orphans(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, ["o_custkey"])


@query("select o_orderstatus as state, count(*) as n from orders group by o_orderstatus union all select l_linestatus, count(*) from lineitem group by l_linestatus")
def q33_health_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state")), read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("state"))
    return resources.states(orders).unionByName(resources.states(items))


@query("""
    with a as (select conv_id, min(turn) as first, max(turn) as last, 3 as events from conversations group by conv_id)
    select a.conv_id, a.first, a.last, count(*) = 3 as covered from a join conversations c on a.conv_id = c.conv_id group by a.conv_id, a.first, a.last
""")
def q34_archive_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    archived = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last")).withColumn("events", F.lit(3).cast("long"))
    return workflow.archive_coverage(turns, archived, ["conv_id"], "turn").select("conv_id", "first", "last", "covered")


@query("select conv_id, turn, case when turn <= 2 then 'archive' else role end as role from conversations")
def q34_archive_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return workflow.compose(turns.where("turn <= 2").withColumn("role", F.lit("archive")), turns, ["conv_id"], "turn")


@query("select conv_id, max_by(role, turn) as role, max(turn) as turn from conversations group by conv_id")
def q35_metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    return workflow.upsert(turns.where("role = 'user'"), turns.where("role <> 'user'"), ["conv_id"], "turn")


@query("select user_id, 'ready' as status from events group by user_id having count(*) filter (value > 400) = 0")
def q36_wake_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 400, "ready").otherwise("done").alias("status"))
    return workflow.wake_once(events, events, ["user_id"])


@query("select event_id, event_type, case when value > 250 then 'ok' else 'stale' end as verdict from events".replace("'ok'", "'completed'").replace("'stale'", "'StaleRuntimeEpoch'"))
def q37_epoch_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    tasks = events.selectExpr("event_id", "'claimed' as status", "case when value > 250 then 2 else 1 end as claimed_epoch")
    return workflow.complete(tasks, events.select("event_id", "event_type"), "event_id", 2)


@query("""
    with u as (select event_id as seq, user_id, case when event_type in ('click', 'view') then 'read' else 'write' end as mode, value <= 250 as done from events),
    x as (select *, coalesce(max(case when mode = 'write' then 1 else 0 end) over w, 0) as wrote, count(*) over w as earlier from u where not done window w as (partition by user_id order by seq rows between unbounded preceding and 1 preceding))
    select seq, user_id, mode from x where not (wrote = 1 or mode = 'write' and earlier > 0)
""")
def q38_incremental_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").selectExpr("event_id as seq", "user_id", "case when event_type in ('click', 'view') then 'read' else 'write' end as mode", "case when value <= 250 then 'completed' else 'pending' end as state")
    return resources.runnable(events, ["user_id"]).select("seq", "user_id", "mode")


@query("""
    with t as (select conv_id, turn, hex(encode(coalesce(text, ''))) as raw from conversations),
    h as (select conv_id, turn, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(raw), 2), lambda i: ('0x' || substr(raw, i, 2))::int::hugeint)), lambda a, b: xor(a, b) * 1099511628211 % 18446744073709551616) as v from t)
    select conv_id, turn, (case when v >= 9223372036854775808 then v - 18446744073709551616 else v end)::bigint as fnv from h
""")
def q39_fnv_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL multiplies in 128 bits and keeps 64."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", hashing.fnv("text").alias("fnv"))


@query("select conv_id, min(turn) as first, max(turn) as last, count(*) as n, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) as bytes from conversations group by conv_id")
def q40_archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation packed into an archive and unpacked again."""
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn as sequence", "2 as kind", "turn * 1000 as utc_ms", "cast(coalesce(text, '') as binary) as payload")
    back = archives.unpack(archives.pack(turns, "conv_id"), "conv_id")
    return back.groupBy("conv_id").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n"), F.sum(F.octet_length("payload").cast("long")).alias("bytes"))


@query("""
    with n as (select user_id, event_type, row_number() over (partition by user_id order by event_id) as decision from events), t as (select user_id, min(decision) filter (event_type in ('purchase', 'error')) as last from n group by user_id),
    d as (select n.* from n join t using (user_id) where decision <= coalesce(last, decision)),
    c as (select * from (values ('signup', 1, 'schedule_activity', 'authenticate'), ('signup', 2, 'schedule_timer', 'login-timeout'), ('signup', 3, 'send_signal', 'login-notify'), ('error', 1, 'compensate', 'revoke-session')) x(event_type, place, kind, payload))
    select user_id, decision, decision * 4294967296 + place as command_sequence, place::bigint as place, kind, encode(payload) as payload from d join c using (event_type)
""")
def q41_login_fold_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a login workflow, folded by a Python transition; the commands that make work."""
    kinds = {"signup": 1, "click": 2, "view": 2, "purchase": 3, "error": 4}
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    history = read(spark, sf_dir, "events").select("user_id", number.alias("sequence"), kind.alias("kind"))
    return workflow.lower_commands(workflow.fold_with(history, ["user_id"], workflow.login, "idle"), ["user_id"])


@query("""
    with t as (select user_id, event_id, event_type as k, case when event_type = 'view' then null else cast(floor(value) as bigint) end as s from events),
    f as (select user_id, list_reduce(list_prepend({'l': []::struct(k varchar, s bigint)[], 'k': null::varchar, 's': null::bigint}, list({'l': []::struct(k varchar, s bigint)[], 'k': k, 's': s} order by event_id)),
        lambda a, x: {'l': case when x.s is null then list_concat(list_filter(a.l, lambda e: e.k <> x.k), list_filter(a.l, lambda e: e.k = x.k)) when x.s > 600 then a.l
            else list_append(list_filter(list_filter(a.l, lambda e: e.k <> x.k), lambda e, i: coalesce(list_sum(list_transform(list_slice(list_filter(a.l, lambda y: y.k <> x.k), i, 1000000), lambda y: y.s)), 0) + x.s <= 600), {'k': x.k, 's': x.s}) end,
            'k': null::varchar, 's': null::bigint}) as r from t group by user_id),
    u as (select user_id, unnest(r.l) as e from f)
    select user_id, e.k as key, e.s as size from u
""")
def q42_lru_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in each user's cache of 600 units after its events put and get."""
    touches = read(spark, sf_dir, "events").selectExpr("user_id", "event_id as tick", "event_type as key", "case when event_type = 'view' then null else cast(floor(value) as bigint) end as size")
    return resources.lru(touches, "user_id", 600)


@query("select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type")
def q43_stream_inbox_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox as a stream over the table's files: each message of a user once, the earliest of its micro-batch."""
    return queues.run_inbox(spark, f"{sf_dir.rstrip('/')}/events.parquet", shared_root(spark), ["user_id", "event_type"], "event_id")


@query("select c_mktsegment, n_name, count(*) as n, cast(sum(cast(floor(o_totalprice * 100) as bigint)) as bigint) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all")
def q44_join_inner_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total"))
