"""Durable workflows as event tables: idempotent starts, inboxes, claims, state folds, commands, timers, archives, audits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import derived_id

#: Numbers of the event kinds, and those that a transition sees.
EVENTS = {
    "started": 1, "signal_received": 2, "activity_completed": 3, "activity_failed": 4, "timer_fired": 5, "command_recorded": 6, "random_recorded": 7, "cancellation_requested": 8, "activity_retry_scheduled": 9, "child_started": 10,
    "child_completed": 11, "child_failed": 12, "child_cancelled": 13, "workflow_terminated": 14, "compensation_plan_started": 15, "compensation_step_completed": 16, "compensation_step_failed": 17, "compensation_plan_completed": 18, "compensation_plan_failed": 19, "definition_migrated": 20,
}
DECISIONS = (1, 2, 3, 4, 5, 8, 11, 12, 13)
TERMINAL = ("completed", "failed", "cancelled", "terminated")


def is_decision(kind: Column) -> Column:
    return kind.isin(*DECISIONS)


def is_metadata(kind: Column) -> Column:
    """All other known kinds: recorded commands, random values and migrations too, which user code never sees."""
    return kind.between(1, 20) & ~kind.isin(*DECISIONS)


def starts(requests: DataFrame, keys: list[str], order: str, request_hash: str) -> DataFrame:
    """``requests`` with ``outcome``: the first of a key starts, equal later ones join it, different ones conflict."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.first(request_hash).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "started").when(F.col(request_hash).eqNullSafe(first), "existing").otherwise("IdempotencyConflict"))


def inbox(messages: DataFrame, keys: list[str], message: str, order: str, next_sequence: Column) -> DataFrame:
    """The first of each message, with its ``sequence`` in the workflow's history from ``next_sequence`` on."""
    first = F.row_number().over(Window.partitionBy(*keys, message).orderBy(order))
    fresh = messages.withColumn("_r", first).where("_r = 1").drop("_r")
    return fresh.withColumn("sequence", (next_sequence + F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def claims(tasks: DataFrame, queue: list[str], available: str, task: str, now: Column, epoch: int, count: int = 1) -> DataFrame:
    """The next ``count`` tasks of each queue: ready and due, or claimed under an older epoch; earliest first, then by id."""
    due = tasks.where(((F.col("status") == "ready") & (F.col(available) <= now)) | ((F.col("status") == "claimed") & (F.col("claimed_epoch") < epoch)))
    rank = F.row_number().over(Window.partitionBy(*queue).orderBy(available, task))
    picked = due.withColumn("_r", rank).where(F.col("_r") <= count).drop("_r")
    return picked.withColumns({"status": F.lit("claimed"), "claimed_epoch": F.lit(epoch).cast("long")})


def complete(tasks: DataFrame, done: DataFrame, task: str, epoch: int) -> DataFrame:
    """``done`` with ``verdict``: completed where the task is claimed under the current epoch, else StaleRuntimeEpoch."""
    held = tasks.where((F.col("status") == "claimed") & (F.col("claimed_epoch") == epoch)).groupBy(task).agg(F.count("*").alias("_n"))
    return done.join(held, task, "left").withColumn("verdict", F.when(F.col("_n") == 1, "completed").otherwise("StaleRuntimeEpoch")).drop("_n")


def recover(tasks: DataFrame) -> DataFrame:
    """Tasks after a restart: claims are given back."""
    return tasks.withColumns({"status": F.when(F.col("status") == "claimed", "ready").otherwise(F.col("status")), "claimed_epoch": F.lit(None).cast("long")})


def wake_once(wakes: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """One new task for each workflow to wake that has none ready or claimed."""
    return wakes.select(*keys).distinct().join(tasks.where("status in ('ready', 'claimed')"), keys, "left_anti").withColumn("status", F.lit("ready"))


#: Numbers of events that are folded together: a long history is many rows, and its parts are put together after.
FOLDED = 4096


def fold_states(history: DataFrame, keys: list[str], sequence: str, kind: str, table: dict[tuple[str, str], str], initial: str) -> DataFrame:
    """``(*keys, state, events)`` of machines given as a table of (state, kind) -> state, folded in order inside the plan.

    Pairs that the table lacks leave the state. No Python, and no history in one row: each stretch of FOLDED numbers is folded for
    every state it may begin in, and the stretches, now maps from state to state, are folded after. ``sequence`` is a whole number.
    """
    names = list(dict.fromkeys([initial, *(a for a, _ in table), *table.values()]))

    def step(state: Column, x: Column) -> Column:
        out = state
        for (a, k), b in table.items():
            out = F.when((state == a) & (x[kind] == k), b).otherwise(out)
        return out

    events = F.array_sort(F.collect_list(F.struct(sequence, kind)))
    part = history.groupBy(*keys, F.expr(f"{sequence} div {FOLDED}").alias("_part")).agg(events.alias("_e"))
    maps = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.aggregate("_e", F.lit(n), step) for n in names)))
    part = part.select(*keys, F.struct("_part", maps.alias("to"), F.size("_e").cast("long").alias("n")).alias("_s"))
    folded = part.groupBy(*keys).agg(F.array_sort(F.collect_list("_s"), lambda a, b: F.when(a["_part"] < b["_part"], -1).when(a["_part"] > b["_part"], 1).otherwise(0)).alias("_s"))
    state = F.aggregate("_s", F.lit(initial), lambda a, x: F.element_at(x["to"], a))
    return folded.select(*keys, state.alias("state"), F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("events"))


@dataclass(frozen=True)
class Outcome:
    """What a transition returns: the state, the status, and commands as (kind, payload)."""

    state: str
    status: str = "running"
    commands: tuple[tuple[str, bytes], ...] = ()


def fold_with(history: DataFrame, keys: list[str], transition: Callable[[str, dict[str, Any]], Outcome], initial: str) -> DataFrame:
    """``(*keys, sequence, state, status, commands)`` after each decision, for transitions that only Python can express.

    ``history``: keys, sequence, kind, payload. Metadata is skipped; a gap in the sequence or an event after the end is an
    error in ``status`` and stops that workflow. A group is one workflow's history.
    """
    schema = ", ".join(f"{k} {history.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, status, previous, out = initial, "running", None, []
        for row in pdf.sort_values("sequence").to_dict("records"):
            wrong = "InvalidSequence" if previous is not None and row["sequence"] != previous + 1 else "TerminalInstance" if status in TERMINAL and row["kind"] in DECISIONS else None
            if wrong:
                out.append((row["sequence"], state, wrong, []))
                break
            previous = row["sequence"]
            if row["kind"] not in DECISIONS:
                continue
            made = transition(state, row)
            state, status = made.state, made.status
            out.append((row["sequence"], state, status, [{"sequence": i + 1, "kind": k, "payload": p} for i, (k, p) in enumerate(made.commands)]))
        first = pdf.iloc[0]
        return pd.DataFrame([(*(first[k] for k in keys), *o) for o in out], columns=[*keys, "sequence", "state", "status", "commands"])

    return history.groupBy(*keys).applyInPandas(run, f"{schema}, sequence long, state string, status string, commands array<struct<sequence: long, kind: string, payload: binary>>")


def login(state: str, event: dict[str, Any]) -> Outcome:
    """The example machine: asks for authentication with a time limit, ends authenticated or timed out."""
    if event["kind"] == EVENTS["started"]:
        return Outcome("waiting", "running", (("schedule_activity", b"authenticate"), ("schedule_timer", b"login-timeout"), ("send_signal", b"login-notify")))
    if event["kind"] == EVENTS["activity_completed"]:
        return Outcome("authenticated", "completed", (("complete", b"logged-in"),))
    if event["kind"] == EVENTS["activity_failed"]:
        return Outcome("timed_out", "failed", (("compensate", b"revoke-session"),))
    return Outcome("waiting")


WORK = ("schedule_activity", "schedule_timer", "send_signal", "start_child", "cancel_child", "compensate")


def lower_commands(folded: DataFrame, keys: list[str]) -> DataFrame:
    """A row per command that makes work: its number in the workflow (decision and place in one long), kind and payload."""
    flat = folded.select(*keys, F.col("sequence").alias("decision"), F.explode("commands").alias("c"))
    number = F.shiftleft(F.col("decision").cast("long"), 32).bitwiseOR(F.col("c.sequence"))
    return flat.where(F.col("c.kind").isin(*WORK)).select(*keys, "decision", number.alias("command_sequence"), F.col("c.sequence").alias("place"), F.col("c.kind").alias("kind"), F.col("c.payload").alias("payload"))


def task_id(workflow_id: bytes, decision: int, place: int, kind: int) -> bytes:
    return derived_id(workflow_id, decision, place, kind)


def verify_replay(history: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions whose recorded command list isn't exactly one and equal to what the fold made: MissingCommands, DuplicateCommands or CommandMismatch."""
    made = history.select(*keys, "sequence", "commands")
    told = recorded.groupBy(*keys, "sequence").agg(F.count("*").alias("_n"), F.first("commands").alias("_told"))
    both = made.join(told, [*keys, "sequence"], "left")
    verdict = F.when(F.col("_n").isNull(), "MissingCommands").when(F.col("_n") > 1, "DuplicateCommands").when(~F.col("commands").eqNullSafe(F.col("_told")), "CommandMismatch")
    return both.select(*keys, "sequence", verdict.alias("verdict")).where("verdict is not null")


def activity_verdicts(tasks: DataFrame, now: Column) -> DataFrame:
    """``tasks`` with ``verdict``: which time limit has passed (to start, to close, between heartbeats), or cancelled."""
    late = lambda since, limit: (F.col(since).isNotNull()) & (now - F.col(since) >= F.col(limit))
    verdict = (
        F.when(F.col("cancel_requested"), "cancelled")
        .when(F.col("started_ms").isNull() & late("scheduled_ms", "schedule_to_start_ms"), "schedule_to_start_timeout")
        .when(late("started_ms", "start_to_close_ms"), "start_to_close_timeout")
        .when(F.col("started_ms").isNotNull() & (now - F.coalesce("heartbeat_ms", "started_ms") >= F.col("heartbeat_timeout_ms")), "heartbeat_timeout")
        .otherwise("running")
    )
    return tasks.withColumn("verdict", verdict)


def due_timers(timers: DataFrame, queue: list[str], now: Column, count: int | None = None) -> DataFrame:
    """Scheduled timers whose time has come, earliest first; at most ``count`` of each queue."""
    due = timers.where((F.col("status") == "scheduled") & (F.col("fire_at") <= now))
    if count is None:
        return due
    return due.withColumn("_r", F.row_number().over(Window.partitionBy(*queue).orderBy("fire_at", "timer_id"))).where(F.col("_r") <= count).drop("_r")


def deliver(outbox: DataFrame, routes: DataFrame) -> DataFrame:
    """Unpublished messages with the workflow that their route names: input for an inbox."""
    return outbox.where("published_ms is null").join(routes, "route").drop("published_ms")


def close_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """What becomes of running children of ended parents: abandoned, asked to cancel (and woken), or terminated. Terminated ones end their own children: call again."""
    ended = parents.where(F.col("status").isin(*TERMINAL)).select(F.col("workflow_id").alias("parent_id"))
    act = F.when(F.col("policy") == 1, "abandoned").when(F.col("policy") == 2, "cancel_requested").otherwise("terminated")
    return children.where(~F.col("status").isin(*TERMINAL)).join(ended, "parent_id").withColumn("action", act)


def next_compensation(steps: DataFrame, plan: list[str], index: str) -> DataFrame:
    """The step to run next in each plan: the highest pending, unless one runs or has failed."""
    w = Window.partitionBy(*plan)
    held = F.max(F.col("status").isin("running", "failed").cast("int")).over(w)
    pending = steps.withColumn("_held", held).where("_held = 0 and status = 'pending'")
    return pending.withColumn("_r", F.row_number().over(w.orderBy(F.desc(index)))).where("_r = 1").drop("_r", "_held")


def migrate(states: DataFrame, steps: dict[int, Callable[[pd.Series], pd.Series]], target: int) -> DataFrame:
    """States (version, state) brought to ``target`` one version at a time; a version without a step is a gap and an error."""
    present = [r["version"] for r in states.select("version").distinct().collect()]  # a row per version in use
    for v in range(min(present, default=target), target):
        if v not in steps:
            raise ValueError(f"MigrationGap at {v}")
        step = F.pandas_udf(steps[v], "string")
        hit = F.col("version") == v
        states = states.withColumns({"state": F.when(hit, step("state")).otherwise(F.col("state")), "version": F.when(hit, v + 1).otherwise(F.col("version"))})
    return states


def unknown_definitions(tasks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Tasks to block, with why: their definition is not registered, or not in this version."""
    known = definitions.select("definition_id").distinct().withColumn("_d", F.lit(True))
    blocked = tasks.join(definitions, ["definition_id", "definition_version"], "left_anti").join(known, "definition_id", "left")
    return blocked.withColumn("reason", F.when(F.col("_d"), "UnknownVersion").otherwise("UnknownDefinition")).drop("_d")


def gaps(history: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """``(*keys, first, last, events)`` of histories that don't run from their first to their last number without a gap or repeat."""
    seen = history.groupBy(*keys).agg(F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.count("*").alias("events"), F.count_distinct(sequence).alias("_d"))
    return seen.where("last - first + 1 <> events or _d <> events").drop("_d")


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents, keys, "left_anti")


def archive_coverage(history: DataFrame, archived: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Archived ranges (first, last, events) with ``covered``: whether the hot rows of the range are all there, so that they may go."""
    hot = archived.join(history, keys).where(F.col(sequence).between(F.col("first"), F.col("last")))
    got = hot.groupBy(*keys, "first", "last", "events").agg(F.count("*").alias("_n"), F.min(sequence).alias("_a"), F.max(sequence).alias("_b"))
    both = archived.join(got, [*keys, "first", "last", "events"], "left")
    return both.withColumn("covered", F.coalesce((F.col("_n") == F.col("events")) & (F.col("_a") == F.col("first")) & (F.col("_b") == F.col("last")), F.lit(False))).drop("_n", "_a", "_b")


def compose(archived: DataFrame, hot: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """A history from archived and hot rows, the archive's first where both have a number."""
    tagged = archived.withColumn("_s", F.lit(0)).unionByName(hot.withColumn("_s", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys, sequence).orderBy("_s"))
    return tagged.withColumn("_r", rank).where("_r = 1").drop("_r", "_s")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: that of the greatest version, a change before what was there."""
    tagged = current.withColumn("_n", F.lit(0)).unionByName(changes.withColumn("_n", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    return tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_n")).alias("_b")).select(*keys, "_b.*")


ROLES = {"viewer": 0, "operator": 1, "admin": 2}


def scoped(df: DataFrame, tenant: str, namespace: str, role: str, needed: str = "viewer") -> DataFrame:
    """Rows of one tenant's namespace, for those whose role suffices."""
    if ROLES[role] < ROLES[needed]:
        raise PermissionError(f"{needed} needed")
    return df.where((F.col("tenant") == tenant) & (F.col("namespace") == namespace))


class Registry:
    """Definitions or activities by id and version with unique names, fixed once frozen."""

    def __init__(self) -> None:
        self.entries: dict[tuple[int, int], tuple[str, Any]] = {}
        self.frozen = False

    def register(self, id_: int, version: int, name: str, value: Any) -> None:
        if self.frozen:
            raise RuntimeError("Frozen")
        if (id_, version) in self.entries:
            raise ValueError("DuplicateVersion")
        if any((n == name) != (i == id_) for (i, _), (n, _) in self.entries.items()):
            raise ValueError("DuplicateName")
        self.entries[id_, version] = (name, value)

    def find(self, id_: int, version: int) -> Any:
        if (id_, version) in self.entries:
            return self.entries[id_, version][1]
        raise KeyError("UnknownVersion" if any(i == id_ for i, _ in self.entries) else "UnknownDefinition")


class ActivityRegistry(Registry):
    """Activities by type id with unique names. Each must tell how a second delivery is made harmless, as all are delivered at least once."""

    CONTRACTS = ("idempotent", "keyed", "compensated")

    def register_activity(self, type_id: int, name: str, idempotency: str, handler: Any) -> None:
        if idempotency not in self.CONTRACTS:
            raise ValueError("IdempotencyContractRequired")
        self.register(type_id, 1, name, (idempotency, handler))

    def by_name(self, name: str) -> Any | None:
        return next((value for n, value in self.entries.values() if n == name), None)
