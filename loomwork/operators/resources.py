"""Resource graphs: access rules, hazards, lifecycles, interval overlays, versions, budgets, caches, fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce as fold

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .algorithms import number_global

KINDS = ("file", "page", "memory_buffer", "database_segment", "gpu_buffer", "texture", "network_blob", "custom")
DIMENSIONS = ("memory", "disk", "network", "device")


def access_error(kind: Column, mode: Column, constraint: Column, low: Column, high: Column, page: Column, shape: Column) -> Column:
    """Why an access is refused, or null: a creation must demand absence and only it may, ranges aren't empty, pages belong to files."""
    return (
        F.when((mode == "create") != (constraint == "must_not_exist"), "InvalidConstraint")
        .when((shape == "bytes") & ~(low < high), "InvalidRange")
        .when((page.isNotNull()) & ~kind.isin("file", "page"), "InvalidRange")
        .when(shape.isin("texture", "custom"), "UnsupportedRange")
    )


def overlap(a: str = "a", b: str = "b") -> Column:
    """Whether two half-open ranges meet; a null end stands for the whole resource."""
    low = lambda x: F.coalesce(F.col(f"{x}.lo"), F.lit(-(1 << 62)))
    high = lambda x: F.coalesce(F.col(f"{x}.hi"), F.lit(1 << 62))
    return (low(a) < high(b)) & (low(b) < high(a))


def _edges(accesses: DataFrame, resource: list[str], order: str, node: str, mode: str) -> DataFrame:
    """Every hazard between accesses of one resource, ``_r`` their order: raw from the last writer to each reader, waw to the next writer, war from the readers since.

    Everything follows from each access's last write before it, so one window and one join on resource and epoch do.
    """
    write = F.col(mode) != "read"
    w = Window.partitionBy(*resource).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = accesses.select(*resource, F.col(order).alias("_o"), F.col(node).alias("_n"), write.alias("_w"))
    seen = seen.withColumn("_epoch", F.coalesce(F.sum(F.col("_w").cast("int")).over(w.orderBy("_o")), F.lit(0)))
    seen = seen.withColumn("_last", F.last(F.when(F.col("_w"), F.col("_n")), ignorenulls=True).over(w.orderBy("_o")))
    direct = seen.where("_last is not null").select(*resource, F.col("_last").alias("src"), F.col("_n").alias("dst"), F.when(F.col("_w"), "waw").otherwise("raw").alias("hazard"), F.col("_o").alias("_o"))
    readers, writers = seen.where("not _w").select(*resource, "_epoch", F.col("_n").alias("src")), seen.where("_w").select(*resource, "_epoch", F.col("_n").alias("dst"), "_o")
    anti = readers.join(writers, [*resource, "_epoch"]).select(*resource, "src", "dst", F.lit("war").alias("hazard"), "_o")
    rank = F.when(F.col("hazard") == "raw", 0).when(F.col("hazard") == "waw", 1).otherwise(2)
    return direct.unionByName(anti).withColumn("_r", F.struct("_o", rank)).drop("_o")


def hazards(accesses: DataFrame, resource: list[str], order: str = "seq", node: str = "node", mode: str = "mode") -> DataFrame:
    """``(*resource, src, dst, hazard)`` of whole-resource accesses.

    Edges of a node to itself are left out; of several hazards between two nodes on a resource the first stays.
    """
    edges = _edges(accesses, resource, order, node, mode).where("src <> dst")
    return edges.groupBy(*resource, "src", "dst").agg(F.min_by("hazard", "_r").alias("hazard"))


def _bucket(column: str, bucket: int, back: int = 0) -> Column:
    """The bucket of a long less ``back``: whole numbers throughout, as doubles end at 2**53."""
    x = f"(cast({column} as long) - {back}L)"
    return F.expr(f"({x} - pmod({x}, {bucket}L)) div {bucket}L")


def _stretches(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """``(*keys, _at, _to)``: the elementary stretches between the borders of a key's ranges."""
    ends = df.select(*keys, F.col(low).alias("_at")).unionByName(df.select(*keys, F.col(high).alias("_at"))).distinct()
    return ends.withColumn("_to", F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at"))).where("_to is not null")


def pieces(df: DataFrame, keys: list[str], low: str, high: str, bucket: int) -> DataFrame:
    """Each range cut at every border of its key: a row per elementary stretch in it, ``_at`` where the stretch begins and ``_to`` where it ends.

    Borders meet ranges by bucket, so no key is compared all with all.
    """
    cuts = _stretches(df, keys, low, high).withColumn("_bucket", _bucket("_at", bucket))
    wide = df.withColumn("_bucket", F.explode(F.sequence(_bucket(low, bucket), _bucket(high, bucket, 1))))
    return wide.join(cuts, [*keys, "_bucket"]).where((F.col("_at") >= F.col(low)) & (F.col("_at") < F.col(high))).drop("_bucket")


def range_hazards(accesses: DataFrame, resource: list[str], bucket: int, order: str = "seq") -> DataFrame:
    """``(*resource, src, dst, hazard)`` of accesses to ranges: every pair of accesses of different nodes that overlap and of which one writes, unless a write of the same stretch stands between.

    ``accesses``: resource columns, node, mode, lo, hi (both null: the whole). Ranges are cut at all borders of their
    resource first, so that each stretch is a resource of its own; whole accesses take part in each, and in one more
    stretch for whatever no range names. Of several hazards between two nodes on a resource the first stays.
    """
    ranged = accesses.where("lo is not null").select(*resource, order, "node", "mode", "lo", "hi")
    whole = accesses.where("lo is null").select(*resource, order, "node", "mode")
    part = [*resource, order, "node", "mode"]
    cut = pieces(ranged, resource, "lo", "hi", bucket).select(*part, F.col("_at").alias("_stretch"))
    over = whole.join(_stretches(ranged, resource, "lo", "hi").select(*resource, F.col("_at").alias("_stretch")), resource).select(*part, "_stretch")
    rest = whole.select(*part, F.lit(None).cast("long").alias("_stretch"))
    own = cut.unionByName(over).unionByName(rest).withColumns({"_rest": F.col("_stretch").isNull(), "_stretch": F.coalesce("_stretch", F.lit(0))})
    edges = _edges(own, [*resource, "_rest", "_stretch"], order, "node", "mode").where("src <> dst")
    return edges.groupBy(*resource, "src", "dst").agg(F.min_by("hazard", "_r").alias("hazard"))


def access_plan(accesses: DataFrame, bucket: int) -> DataFrame:
    """``(src, dst, name, hazard)``: the plan of files, pages and ranges; of a pair of nodes the first hazard on any resource stays.

    ``accesses``: name, seq, node, mode, page (null: the whole file), lo, hi (null: the whole page or file). An access to a file is
    a barrier for all its pages; pages meet if they are the same and their ranges overlap. ``src = dst`` is a cycle of one node,
    for ``plan_errors`` to tell.
    """
    part = ["name", "seq", "node", "mode"]
    files = accesses.where("page is null").select(*part)
    pages = accesses.where("page is not null and lo is null").select(*part, "page")
    ranged = accesses.where("page is not null and lo is not null").select(*part, "page", "lo", "hi")
    # what a page consists of: its stretches, and one for whatever no range names
    of_page = _stretches(ranged, ["name", "page"], "lo", "hi").select("name", "page", F.col("_at").alias("at"))
    of_page = of_page.unionByName(accesses.where("page is not null").select("name", "page").distinct().withColumn("at", F.lit(None).cast("long")))
    cut = pieces(ranged, ["name", "page"], "lo", "hi", bucket).select(*part, "page", F.col("_at").alias("at"))
    own = cut.unionByName(pages.join(of_page, ["name", "page"]).select(*part, "page", "at")).unionByName(files.join(of_page, "name").select(*part, "page", "at"))
    own = own.unionByName(files.select(*part, F.lit(None).cast("long").alias("page"), F.lit(None).cast("long").alias("at")))
    own = own.withColumns({"_file": F.col("page").isNull(), "_rest": F.col("at").isNull(), "page": F.coalesce("page", F.lit(0)), "at": F.coalesce("at", F.lit(0))})
    edges = _edges(own, ["name", "_file", "page", "_rest", "at"], "seq", "node", "mode")
    best = edges.groupBy("src", "dst").agg(F.min_by(F.struct("name", "hazard"), F.struct("_r", "name")).alias("_b"))
    return best.select("src", "dst", "_b.name", "_b.hazard")


def plan_errors(plan: DataFrame) -> DataFrame:
    """Nodes that wait for themselves: ``(node, error)``."""
    return plan.where("src = dst").select(F.col("src").alias("node"), F.lit("CycleDetected").alias("error"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Pairs of ranges (lo, hi on both sides) of a key that overlap: both are dealt to the buckets that they touch, and a pair counts in the first they share."""
    deal = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys)).withColumn("_b", F.explode(F.sequence(_bucket(f"{p}_lo", bucket), _bucket(f"{p}_hi", bucket, 1))))
    met = deal(left, "a").join(deal(right, "b"), [*keys, "_b"]).where("a_lo < b_hi and b_lo < a_hi")
    return met.withColumn("_lo", F.greatest("a_lo", "b_lo")).where(F.col("_b") == _bucket("_lo", bucket)).drop("_b", "_lo")


def overlay(ranges: DataFrame, keys: list[str], order: str, bucket: int) -> DataFrame:
    """``(*keys, lo, hi, value)`` after writing ranges one over another in ``order``: the last value of each stretch, equal neighbours joined."""
    cut = pieces(ranges, keys, "lo", "hi", bucket)
    top = cut.groupBy(*keys, "_at", "_to").agg(F.max_by("value", order).alias("value"))
    w = Window.partitionBy(*keys).orderBy("_at")
    starts = ~((F.lag("_to").over(w) == F.col("_at")) & F.lag("value").over(w).eqNullSafe(F.col("value")))
    islands = top.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("_i", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_i").agg(F.min("_at").alias("lo"), F.max("_to").alias("hi"), F.first("value").alias("value")).drop("_i")


def lifecycle_violations(accesses: DataFrame, resource: list[str], order: str, mode: str) -> DataFrame:
    """Accesses that their resource's state forbids: creating what is present; reading, writing or deleting what was deleted."""
    w = Window.partitionBy(*resource).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col(mode) == "delete", "absent").otherwise("present"), ignorenulls=True).over(w)
    bad = ((F.col(mode) == "create") & (F.col("_s") == "present")) | ((F.col(mode) != "create") & (F.col("_s") == "absent"))
    return accesses.withColumn("_s", state).where(bad).drop("_s")


def versions(accesses: DataFrame, resource: list[str], order: str, mode: str) -> DataFrame:
    """``(…, generation, state)`` of every access that makes a version: writes and creations are present, deletions leave a tombstone."""
    w = Window.partitionBy(*resource).orderBy(order)
    return accesses.where(F.col(mode) != "read").withColumns({"generation": F.row_number().over(w), "state": F.when(F.col(mode) == "delete", "tombstone").otherwise("present")})


def constraint_check(wanted: DataFrame, current: DataFrame, resource: list[str]) -> DataFrame:
    """``wanted`` (constraint any, must_not_exist, exact with hash, generation with number) with ``verdict`` against current versions."""
    now = current.select(*resource, F.col("generation").alias("_g"), F.col("state").alias("_s"), F.col("content_hash").alias("_h"))
    there = F.coalesce(F.col("_s") == "present", F.lit(False))
    ok = (
        F.when(F.col("constraint") == "any", True)
        .when(F.col("constraint") == "must_not_exist", ~there)
        .when(F.col("constraint") == "exact", there & F.coalesce(F.col("_h") == F.col("expected"), F.lit(False)))
        .when(F.col("constraint") == "generation", there & F.coalesce(F.col("_g") == F.col("expected"), F.lit(False)))
        .otherwise(False)
    )
    return wanted.join(now, resource, "left").withColumn("verdict", F.when(ok, "ok").otherwise("VersionMismatch")).drop("_g", "_s", "_h")


def runnable(submissions: DataFrame, resource: list[str]) -> DataFrame:
    """Unfinished submissions without an earlier unfinished one that touches the same resource while one of them writes: ``seq, state, mode`` and resource columns."""
    open_ = submissions.where(~F.col("state").isin("completed", "failed", "cancelled"))
    w = Window.partitionBy(*resource).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.coalesce(F.max((F.col("mode") != "read").cast("int")).over(w), F.lit(0))
    earlier = F.count("*").over(w)
    blocked = open_.withColumns({"_w": wrote, "_n": earlier}).where("_w = 1 or (mode <> 'read' and _n > 0)").select("seq").distinct()
    return open_.join(blocked, "seq", "left_anti").drop("_w", "_n")


def admit(requests: DataFrame, group: str, order: str, capacity: dict[str, int]) -> DataFrame:
    """``requests`` with ``admitted``: in order, whatever fits into what is left of all dimensions at once.

    A refused request takes nothing, so this is no running sum: rows go by group and in order through one pass that holds the
    sums of the group it is in, whatever its size. A group is one budget's queue and decided by one task.
    """
    dims = [d for d in capacity if d in requests.columns]
    slim = requests.select(group, order, *dims).repartition(group).sortWithinPartitions(group, order)
    schema = f"{group} {requests.schema[group].dataType.simpleString()}, {order} {requests.schema[order].dataType.simpleString()}, admitted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, begun = None, [0] * len(dims), False
        for batch in batches:
            ok = []
            for key, *wanted in zip(batch.column(0).to_pylist(), *(batch.column(i + 2).to_pylist() for i in range(len(dims))), strict=True):
                if not begun or key != now:
                    now, used, begun = key, [0] * len(dims), True
                after = [a + x for a, x in zip(used, wanted, strict=True)]
                fits = all(a <= capacity[d] for a, d in zip(after, dims, strict=True))
                used = after if fits else used
                ok.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], [group, order, "admitted"])

    return requests.join(slim.mapInArrow(run, schema), [group, order])


def can_ever_fit(capacity: dict[str, int]) -> Column:
    return fold(lambda p, q: p & q, [F.col(d) <= most for d, most in capacity.items()])


def ready_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` (unlock, mean_ns, node) with ``place``: what unlocks most first, then what takes longest, then the lower number."""
    return number_global(nodes, [F.desc("unlock"), F.desc("mean_ns"), F.asc("node")], "place")


def fusion_groups(nodes: DataFrame, keys: list[str], order: str, kind: str, proofs: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``(*keys, kind, first, last, members)`` of chains of neighbours of one kind.

    ``proofs`` (kind, proof): only kinds with a proof that isn't empty fuse, the others stay alone. ``edges`` (src, dst, over
    ``order``): neighbours fuse only if the one is all that waits for the other, and that all it waits for.
    """
    joins = F.lag(kind).over(w := Window.partitionBy(*keys).orderBy(order)).eqNullSafe(F.col(kind))
    runs = nodes.withColumn("_before", F.lag(order).over(w))
    if proofs is not None:
        allowed = proofs.where("proof <> ''").select(F.col("kind").alias("_kind")).distinct()
        runs = runs.join(allowed, runs[kind] == allowed["_kind"], "left")
        joins = joins & F.col("_kind").isNotNull()
    if edges is not None:
        out, in_ = (edges.groupBy(F.col(c).alias(f"_{c}")).agg(F.count("*").alias(f"_n_{c}"), F.min(o).alias(f"_to_{c}")) for c, o in (("src", "dst"), ("dst", "src")))
        runs = runs.join(out, runs["_before"] == out["_src"], "left").join(in_, runs[order] == in_["_dst"], "left")
        joins = joins & F.coalesce((F.col("_n_src") == 1) & (F.col("_n_dst") == 1) & (F.col("_to_src") == F.col(order)), F.lit(False))
    runs = runs.withColumn("_n", (~joins).cast("int")).withColumn("_g", F.sum("_n").over(w))
    return runs.groupBy(*keys, kind, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("members")).drop("_g")


def lru(touches: DataFrame, cache: str, capacity: int) -> DataFrame:
    """``(cache, key, size)`` left in each cache after its touches (tick, key, size; size null for a get), the least recent evicted until all fits.

    Entries larger than the cache are ignored; putting a key again replaces it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        for key, size in pdf.sort_values("tick")[["key", "size"]].itertuples(index=False):
            if pd.isna(size):
                if key in held:
                    held[key] = held.pop(key)
                continue
            if size > capacity:
                continue
            held.pop(key, None)
            while held and sum(held.values()) + size > capacity:
                del held[next(iter(held))]
            held[key] = int(size)
        name = pdf[cache].iloc[0]
        return pd.DataFrame({cache: [name] * len(held), "key": list(held), "size": list(held.values())})

    return touches.groupBy(cache).applyInPandas(run, f"{cache} {touches.schema[cache].dataType.simpleString()}, key string, size long")


def states(nodes: DataFrame, state: str = "state") -> DataFrame:
    return nodes.groupBy(state).agg(F.count("*").alias("n"))
