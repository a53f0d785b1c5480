"""Entity-component tables: one wide row per entity, a nullable column per component, queries, command batches, snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64
from ..functions.scalars import is_newer
from .algorithms import number_global


class Components:
    """Component names and types, frozen once the first entity exists; a component's id is the hash of its name."""

    def __init__(self) -> None:
        self.types: dict[str, str] = {}
        self.frozen = False

    def register(self, name: str, kind: str) -> int:
        if self.frozen:
            raise RuntimeError("the registry is frozen")
        if name in self.types:
            raise ValueError(f"component {name} is registered")
        self.types[name] = kind
        return fnv1a64(name.encode())

    def schema(self) -> str:
        self.frozen = True
        return ", ".join(["entity_index long", "entity_generation long", *(f"{n} {t}, {n}_ver long" for n, t in self.types.items())])


@dataclass(frozen=True)
class Query:
    """What a system touches. ``changed`` restricts to rows of which one of these components is newer than the cursor."""

    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    changed: tuple[str, ...] = ()
    read: tuple[str, ...] = ()
    write: tuple[str, ...] = ()

    def validate(self) -> None:
        seen = {*self.required, *self.optional}
        for wrong, why in (
            (len({*self.write}) < len(self.write), "a component is written twice"),
            (bool({*self.write} - seen), "a written component is neither required nor optional"),
            (len({*self.read}) < len(self.read), "a component is read twice"),
            (bool({*self.read} & {*self.write}), "a component is read and written"),
        ):
            if wrong:
                raise ValueError(why)


def run_query(world: DataFrame, query: Query, cursor: Column | None = None) -> DataFrame:
    """The entities that match, with the columns the query may touch. All predicates are null tests and reach the scan."""
    query.validate()
    found = world
    for name in query.required:
        found = found.where(F.col(name).isNotNull())
    for name in query.excluded:
        found = found.where(F.col(name).isNull())
    if query.changed and cursor is not None:
        tests = [F.col(name).isNotNull() & is_newer(F.col(f"{name}_ver"), cursor) for name in query.changed if name in world.columns]
        if tests:
            any_ = tests[0]
            for t in tests[1:]:
                any_ = any_ | t
            found = found.where(any_)
    names = dict.fromkeys((*query.required, *query.optional, *query.read, *query.write))
    keys = [c for c in ("entity_index", "entity_generation") if c in world.columns]
    return found.select(*keys, *names)


def relational_query(entities: DataFrame, key: str, required: list[DataFrame], excluded: list[DataFrame], optional: list[DataFrame]) -> DataFrame:
    """The same over one table per component: semi joins, anti joins and outer joins."""
    for df in required:
        entities = entities.join(df, key, "left_semi")
    for df in excluded:
        entities = entities.join(df, key, "left_anti")
    for df in optional:
        entities = entities.join(df, key, "left")
    return entities


def write_component(world: DataFrame, name: str, value: Column, tick: int) -> DataFrame:
    """Set a component where the entity has it; its version becomes ``tick``."""
    has = F.col(name).isNotNull()
    return world.withColumns({name: F.when(has, value), f"{name}_ver": F.when(has, F.lit(tick)).otherwise(F.col(f"{name}_ver"))})


def signature(components: list[str]) -> Column:
    """Sorted names of the components an entity has: its archetype."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in components))))


def add_components(world: DataFrame, added: DataFrame, name: str, tick: int) -> DataFrame:
    """The world after components were added to entities (entity_index, value): one that is there already is set."""
    new = added.select("entity_index", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    met = world.join(new, "entity_index", "left")
    return met.withColumns({name: F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(name)), f"{name}_ver": F.when(F.col("_hit"), F.lit(tick)).otherwise(F.col(f"{name}_ver"))}).select(*world.columns)


def remove_components(world: DataFrame, removed: DataFrame, name: str, tick: int) -> DataFrame:
    """The world without a component of some entities (entity_index): removing what is missing does nothing."""
    met = world.join(removed.select("entity_index", F.lit(True).alias("_hit")).distinct(), "entity_index", "left")
    had = F.col("_hit") & F.col(name).isNotNull()
    return met.withColumns({name: F.when(F.coalesce(had, F.lit(False)), None).otherwise(F.col(name)), f"{name}_ver": F.when(F.coalesce(had, F.lit(False)), F.lit(tick)).otherwise(F.col(f"{name}_ver"))}).select(*world.columns)


class CommandBuffer:
    """Commands recorded on the driver, in order, for one batch; targets that don't exist yet are temporary ids below 0."""

    SCHEMA = "sequence long, kind string, target long, generation long, component string, value string"

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.made = 0

    def _record(self, kind: str, target: int, generation: int | None, component: str | None = None, value: str | None = None) -> None:
        self.rows.append((len(self.rows) + 1, kind, target, generation, component, value))

    def create(self) -> int:
        self.made += 1
        self._record("create", -self.made, None)
        return -self.made

    def destroy(self, target: int, generation: int | None = None) -> None:
        self._record("destroy", target, generation)

    def add(self, target: int, component: str, value: str, generation: int | None = None) -> None:
        self._record("add", target, generation, component, value)

    def remove(self, target: int, component: str, generation: int | None = None) -> None:
        self._record("remove", target, generation, component)

    def set(self, target: int, component: str, value: str, generation: int | None = None) -> None:
        self._record("set", target, generation, component, value)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The batch as a table, and an empty buffer."""
        rows, self.rows, self.made = self.rows, [], 0
        return spark.createDataFrame(rows, self.SCHEMA)


class ImmediateEvent:
    """Subscribers that are called at once, in the order in which they came."""

    def __init__(self) -> None:
        self.subscribers: list[Callable[[object], None]] = []

    def subscribe(self, call: Callable[[object], None]) -> None:
        self.subscribers.append(call)

    def emit(self, value: object) -> None:
        for call in self.subscribers:
            call(value)


def canonical(world: DataFrame, components: list[str], per_chunk: int = 1024) -> DataFrame:
    """A snapshot's rows in canonical order: by signature (component ids, ascending, compared one by one, a shorter list first), chunk and row.

    ``place`` is a row's number over the whole snapshot, ``archetype`` that of its signature, ``chunk`` and ``row`` the place in it.
    """
    ids = {c: fnv1a64(c.encode()) for c in components}
    named = sorted(components, key=ids.__getitem__)
    # fixed width, so that the order of the digits is that of the ids
    key = F.concat(*(F.when(F.col(c).isNotNull(), F.lit(f"{ids[c]:016x}")).otherwise("") for c in named))
    rows = number_global(world.withColumn("signature", key), [F.asc("signature"), F.asc("entity_index"), F.asc("entity_generation")], "place")
    sizes = rows.groupBy("signature").agg(F.min("place").alias("_first"))
    # a row per signature: at most one for each set of components
    first = sizes.withColumn("archetype", (F.row_number().over(Window.orderBy("signature")) - 1).cast("long"))
    placed = rows.join(F.broadcast(first) if len(components) <= 10 else first, "signature").withColumn("_n", F.col("place") - F.col("_first"))
    return placed.withColumns({"chunk": F.expr(f"_n div {per_chunk}"), "row": F.expr(f"_n % {per_chunk}")}).drop("_n", "_first")


def restore_errors(stored: dict[str, tuple[str, int]], registered: dict[str, tuple[str, int]], migrations: set[tuple[str, int]]) -> list[tuple[str, str]]:
    """Why a snapshot with components ``name -> (type, version)`` can't be read into a registry of the same form: ``(name, error)``.

    Both must have the same components and types; an older version needs a migration (name, from) of just one step.
    """
    found = [(n, "UnknownComponent") for n in sorted(stored.keys() - registered.keys())] + [(n, "SchemaMismatch") for n in sorted(registered.keys() - stored.keys())]
    for name in sorted(stored.keys() & registered.keys()):
        (kind, version), (now, wanted) = stored[name], registered[name]
        if kind != now:
            found.append((name, "SchemaMismatch"))
        elif version != wanted:
            found.append((name, "MissingMigration") if (name, version) not in migrations else (name, "MigrationGap") if version + 1 != wanted else ())
    return [f for f in found if f]


def restore(snapshot: DataFrame, stored: dict[str, tuple[str, int]], registered: dict[str, tuple[str, int]], steps: dict[tuple[str, int], Callable[[Column], Column]]) -> DataFrame:
    """A world from a snapshot: checked whole before anything is read, older components brought up by one step."""
    wrong = restore_errors(stored, registered, set(steps))
    if wrong:
        raise ValueError(f"{wrong[0][1]}: {wrong[0][0]}")
    changed = {name: steps[name, version](F.col(name)) for name, (_, version) in stored.items() if version != registered[name][1]}
    return snapshot.withColumns(changed) if changed else snapshot


def normalize(commands: DataFrame, target: str = "target", sequence: str = "sequence", kind: str = "kind") -> DataFrame:
    """A batch without what a destroy makes void: of a destroyed target only its first destroy stays."""
    w = Window.partitionBy(target)
    doomed = F.max((F.col(kind) == "destroy").cast("int")).over(w) == 1
    first = F.min(F.when(F.col(kind) == "destroy", F.col(sequence))).over(w)
    return commands.withColumns({"_doomed": doomed, "_first": first}).where(~F.col("_doomed") | (F.col(sequence) == F.col("_first"))).drop("_doomed", "_first")


def invalid(commands: DataFrame, world: DataFrame, known: list[str]) -> DataFrame:
    """Commands that must stop the whole batch before anything changes: unknown component, stale entity, set of what is missing.

    ``commands``: sequence, kind, target, generation, component; ``world``: entity_index, entity_generation, components.
    A set is valid if the entity has the component, or the batch adds it before.
    """
    unknown = commands.where(F.col("kind").isin("add", "set", "remove") & ~F.col("component").isin(*known)).select("sequence", F.lit("UnknownComponent").alias("error"))
    alive = world.select(F.col("entity_index").alias("target"), F.col("entity_generation").alias("generation"), signature([c for c in known if c in world.columns]).alias("has"))
    old = commands.where("generation is not null")
    stale = old.join(alive, ["target", "generation"], "left_anti").select("sequence", F.lit("StaleEntity").alias("error"))
    w = Window.partitionBy("target", "component").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = old.withColumn("before", F.last(F.when(F.col("kind").isin("add", "set"), True).when(F.col("kind") == "remove", False), ignorenulls=True).over(w))
    missing = last.where("kind = 'set'").join(alive, ["target", "generation"]).where("not coalesce(before, array_contains(has, component))").select("sequence", F.lit("MissingComponent").alias("error"))
    return unknown.unionByName(stale).unionByName(missing)


def last_writes(commands: DataFrame, keys: list[str], sequence: str = "sequence", kind: str = "kind", value: str = "value") -> DataFrame:
    """The last command on each key: what a batch comes to. Combined before the shuffle."""
    best = F.max_by(F.struct(F.col(kind), F.col(value)), F.col(sequence))
    return commands.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{kind}").alias(kind), F.col(f"_b.{value}").alias(value))


def apply_commands(world: DataFrame, commands: DataFrame, component: str, tick: int) -> DataFrame:
    """The next version of one component's column: last writer wins, removing what is missing does nothing, destroyed entities go.

    ``commands``: sequence, kind (destroy, add, set, remove), target, component, value.
    """
    batch = normalize(commands)
    gone = batch.where("kind = 'destroy'").select(F.col("target").alias("entity_index"))
    last = last_writes(batch.where((F.col("kind") != "destroy") & (F.col("component") == component)), ["target"])
    joined = world.join(gone, "entity_index", "left_anti").join(last.withColumnRenamed("target", "entity_index"), "entity_index", "left")
    now = F.when(F.col("kind").isNull(), F.col(component)).when(F.col("kind") == "remove", None).otherwise(F.col("value"))
    return joined.withColumns({component: now, f"{component}_ver": F.when(F.col("kind").isNull(), F.col(f"{component}_ver")).otherwise(F.lit(tick))}).drop("kind", "value")


def assign_entities(requests: DataFrame, free: DataFrame, next_index: int, order: str = "sequence") -> DataFrame:
    """Indices and generations for the creations of one batch: free ones latest first, then new ones.

    ``free``: entity_index, generation, freed_at. A batch is one world's frame; its creations are numbered range by range.
    """
    want = number_global(requests, [F.asc(order)], "n")
    have = number_global(free, [F.desc("freed_at"), F.asc("entity_index")], "n").select("n", F.col("entity_index").alias("_i"), (F.pmod(F.col("generation") + 1, F.lit(1 << 32))).alias("_g"))
    # the first creations take what is free, so a fresh one's place among the fresh is its own less the number of free ones
    held = free.count()
    return want.join(have, "n", "left").select(
        *requests.columns, F.coalesce("_i", F.lit(next_index - 1 - held) + F.col("n")).alias("entity_index"), F.when(F.col("_i").isNull(), 1).otherwise(F.greatest("_g", F.lit(1))).alias("entity_generation")
    )


def frame_events(*sources: DataFrame) -> DataFrame:
    """Events of several buffers in one order: frame, then global sequence."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy("sequence")).cast("long"))


def delta(before: DataFrame, after: DataFrame, key: str, components: list[str]) -> DataFrame:
    """``(key, component, op)``: create and destroy of entities, and add, remove or set of the components that differ."""
    a = before.select(F.col(key).alias("_k"), F.lit(True).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in components))
    b = after.select(key, F.lit(True).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in components))
    both = a.join(b, a["_k"] == b[key], "full")
    ops = [F.when(F.col("_a").isNull(), F.struct(F.lit(None).cast("string").alias("component"), F.lit("create").alias("op"))).when(F.col("_b").isNull(), F.struct(F.lit(None).cast("string").alias("component"), F.lit("destroy").alias("op")))]
    for c in components:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        op = F.when(x.isNull() & y.isNotNull(), "add").when(x.isNotNull() & y.isNull(), "remove").when(~x.eqNullSafe(y), "set")
        ops.append(F.when(F.col("_b").isNotNull() & op.isNotNull(), F.struct(F.lit(c).alias("component"), op.alias("op"))))
    return both.select(F.coalesce("_k", key).alias(key), F.explode(F.array_compact(F.array(*ops))).alias("_o")).select(key, "_o.component", "_o.op")


def content_hash(df: DataFrame, columns: list[str]) -> int | None:
    """A hash of a table that doesn't depend on the order of rows; None for none."""
    return df.agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()["h"]


def apply_delta(before: DataFrame, changes: DataFrame, after: DataFrame, key: str, components: list[str], base: int | None = None, target: int | None = None) -> DataFrame:
    """``before`` with the rows that ``changes`` names taken from ``after``; both hashes are checked where given."""
    if base is not None and content_hash(before, [key, *components]) != base:
        raise ValueError("the delta was made on another base")
    touched = changes.select(key).distinct()
    result = before.join(touched, key, "left_anti").select(key, *components).unionByName(after.join(touched, key, "left_semi").select(key, *components))
    if target is not None and content_hash(result, [key, *components]) != target:
        raise ValueError("the result isn't what the delta promised")
    return result


def replayable() -> Column:
    """Whether a frame has its seed and every input that it requires."""
    told = [~F.col(f"require_{x}") | (F.octet_length(F.coalesce(x, F.lit(b""))) != 0) for x in ("input", "network", "external")]
    return F.col("random_seed").isNotNull() & told[0] & told[1] & told[2]


def journal(frames: DataFrame, capacity: int, by: list[str] | None = None) -> DataFrame:
    """The last ``capacity`` frames of each journal, with ``replayable`` if their input columns are there."""
    if capacity < 1:
        raise ValueError("a journal holds one frame at least")
    rank = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc("number")))
    kept = frames.withColumn("_r", rank).where(F.col("_r") <= capacity).drop("_r")
    return kept.withColumn("replayable", replayable()) if "require_input" in frames.columns else kept


@dataclass
class RollbackRing:
    """The last versions of a world by frame, as DataFrames of immutable files."""

    capacity: int
    frames: dict[int, tuple[DataFrame, int | None]] = field(default_factory=dict)

    def push(self, number: int, world: DataFrame, columns: list[str]) -> None:
        if self.frames and number <= max(self.frames):
            raise ValueError("frames must ascend")
        self.frames[number] = (world, content_hash(world, columns))
        while len(self.frames) > self.capacity:
            del self.frames[min(self.frames)]

    def rollback(self, number: int) -> DataFrame:
        world, _ = self.frames[number]
        self.frames = {n: x for n, x in self.frames.items() if n <= number}
        return world

    def replay(self, number: int, step, upto: int, columns: list[str]) -> DataFrame:
        """Steps from a frame on; a hash that differs from the recorded one stops it."""
        world = self.frames[number][0]
        for n in range(number + 1, upto + 1):
            world = step(world, n)
            if n in self.frames and content_hash(world, columns) != self.frames[n][1]:
                raise ValueError(f"frame {n} differs")
        return world
