"""Durable workflows in batches: each operator takes tables as they are and a batch of requests, and returns what each request came to and the rows it makes.

Requests of a batch are decided in the order of ``arrival`` within what they share (a key, a message, a workflow), by windows
and joins; nothing is decided one by one. A caller publishes all tables of one batch as one version (``sources.stores``), so
a batch happens whole or not at all. Workflow ids are unique; tenant and namespace are carried where a rule names them.

Null arrivals, keys or ids are errors of the caller's; null payloads stay null. Empty batches give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import big_endian, fnv
from .workflow import EVENTS, TERMINAL, wake_once

SCOPE = ["tenant", "namespace"]

#: The failure code of each way in which an activity ends without a result.
ACTIVITY_CODES = {
    "schedule_to_start_timeout": 1001, "start_to_close_timeout": 1002, "heartbeat_timeout": 1003, "cancelled": 1004, "output_schema_mismatch": 1005, "shutdown": 1006, "executor_unavailable": 1007,
}

#: The longest principal, reason and idempotency key of an operator's request.
LONGEST = {"principal": 256, "reason": 4096, "idempotency_key": 256}


class TransitionStore(Protocol):
    """What a store of workflows must do: publish all tables of one batch of transitions at once, or none of them."""

    def commit(self, tables: dict[str, DataFrame], expected_version: int) -> int:
        """The new version; an error if another one than ``expected_version`` is current."""


def request_hash(definition_id: Column, definition_version: Column, schema_id: Column, schema_version: Column, name: Column, payload: Column) -> Column:
    """The hash by which two start requests of one key are the same: a header of fixed width, the definition's name, the input."""
    raw_name, raw = (F.coalesce(c.cast("binary"), F.lit(b"")) for c in (name, payload))
    header = [big_endian(definition_id, 8), big_endian(definition_version, 4), big_endian(schema_id, 8), big_endian(schema_version, 4), big_endian(F.octet_length(raw_name), 4), big_endian(F.octet_length(raw), 8)]
    return fnv(F.concat(*header, raw_name, raw))


def start_outcomes(requests: DataFrame, known: DataFrame, instances: DataFrame, most: int, allowed: Column | None = None) -> DataFrame:
    """``requests`` with ``outcome`` and, where there is one, the id of the workflow that answers it as ``workflow_id``.

    ``requests``: tenant, namespace, idempotency_key, request_hash, workflow_id, arrival and more; ``known``: the ledger of
    keys (tenant, namespace, idempotency_key, request_hash, workflow_id). Unauthorized where ``allowed`` doesn't hold;
    QuotaExceeded once a namespace has ``most`` workflows, for repeated keys too; else the first of a new key is started,
    equal ones are existing, others are an IdempotencyConflict. Order matters within a namespace only.
    """
    key = [*SCOPE, "idempotency_key"]
    asked = requests.withColumn("_may", F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True))
    told = known.select(*key, F.col("request_hash").alias("_hash"), F.col("workflow_id").alias("_id"))
    held = instances.groupBy(*SCOPE).agg(F.count("*").alias("_held"))
    joined = asked.join(told, key, "left").join(held, SCOPE, "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    of_key = Window.partitionBy(*key, "_may").orderBy("arrival")
    joined = joined.withColumn("_new", F.col("_may") & F.col("_hash").isNull() & (F.row_number().over(of_key) == 1))
    before = F.coalesce(F.sum(F.col("_new").cast("int")).over(Window.partitionBy(*SCOPE).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = joined.withColumn("_full", F.col("_held") + before >= most)
    all_ = of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_hash, first_id = (F.first(F.when(F.col("_new"), F.col(c)), ignorenulls=True).over(all_) for c in ("request_hash", "workflow_id"))
    joined = joined.withColumns({"_hash": F.coalesce("_hash", first_hash), "_id": F.coalesce("_id", first_id)})
    same = F.col("request_hash").eqNullSafe(F.col("_hash"))
    outcome = (
        F.when(~F.col("_may"), "Unauthorized")
        .when(F.col("_full"), "QuotaExceeded")
        .when(F.col("_new"), "started")
        .when(same, "existing")
        .otherwise("IdempotencyConflict")
    )
    done = joined.withColumn("outcome", outcome)
    answer = F.when(F.col("outcome").isin("started", "existing"), F.col("_id"))
    return done.withColumn("workflow_id", answer).select(*requests.columns, "outcome")


def opened(outcomes: DataFrame) -> dict[str, DataFrame]:
    """The rows that started workflows make: instance, first event, ready task, key. ``outcomes`` also has definition_id, definition_version, payload and utc_ms."""
    new = outcomes.where("outcome = 'started'")
    return {
        "instances": new.selectExpr(
            *SCOPE, "workflow_id", "definition_id", "definition_version", "'running' as status", "cast('' as binary) as state", "0L as state_version", "2L as next_sequence", "0L as last_processed", "utc_ms as updated_ms"
        ),
        "history": new.selectExpr(*SCOPE, "workflow_id", "1L as sequence", f"{EVENTS['started']} as kind", "utc_ms", "payload"),
        "tasks": new.selectExpr(*SCOPE, "workflow_id", "'ready' as status", "utc_ms as available_ms", "cast(null as long) as claimed_epoch"),
        "keys": new.selectExpr(*SCOPE, "idempotency_key", "request_hash", "workflow_id"),
    }


@dataclass(frozen=True)
class Received:
    """What a batch of messages comes to: a verdict each, the events for the histories, instances as they then are, tasks to add."""

    verdicts: DataFrame
    events: DataFrame
    instances: DataFrame
    tasks: DataFrame


def append_events(events: DataFrame, instances: DataFrame, order: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """``events`` (workflow_id, utc_ms, …) numbered on from each instance's ``next_sequence``, and ``instances`` as they then are."""
    rank = F.row_number().over(Window.partitionBy("workflow_id").orderBy(order))
    placed = events.withColumn("_r", rank).join(instances.select("workflow_id", F.col("next_sequence").alias("_n")), "workflow_id")
    placed = placed.withColumn("sequence", (F.col("_n") + F.col("_r") - 1).cast("long")).drop("_r", "_n")
    more = events.groupBy("workflow_id").agg(F.count("*").alias("_m"), F.max("utc_ms").alias("_at"))
    moved = instances.join(more, "workflow_id", "left").withColumns({"next_sequence": F.col("next_sequence") + F.coalesce("_m", F.lit(0)), "updated_ms": F.coalesce("_at", "updated_ms")})
    return placed, moved.select(*instances.columns)


def receive(messages: DataFrame, inbox: DataFrame, instances: DataFrame, tasks: DataFrame) -> Received:
    """``messages``: tenant, namespace, message_id, workflow_id, kind, utc_ms, arrival, payload.

    A message is appended the first time it comes to a running workflow; the same id in the namespace again is a duplicate,
    also of another workflow that exists; no such workflow, or an ended one, is NotFound and remembers nothing. Each
    workflow that gets a message is woken once.
    """
    key = [*SCOPE, "message_id"]
    there = instances.select("workflow_id", F.col("status").alias("_status"))
    seen = inbox.select(*key).distinct().withColumn("_seen", F.lit(True))
    met = messages.join(there, "workflow_id", "left").join(seen, key, "left")
    fits = (F.col("_status") == "running") & F.col("_seen").isNull()
    rank = F.sum(F.coalesce(fits, F.lit(False)).cast("int")).over(Window.partitionBy(*key).orderBy("arrival"))
    met = met.withColumns({"_fits": F.coalesce(fits, F.lit(False)), "_rank": rank})
    verdict = (
        F.when(F.col("_status").isNull(), "NotFound")
        .when(F.col("_fits") & (F.col("_rank") == 1), "appended")
        .when(F.col("_seen").isNotNull() | (F.col("_rank") > 0), "duplicate")
        .otherwise("NotFound")
    )
    verdicts = met.withColumn("verdict", verdict).select(*messages.columns, "verdict")
    events, moved = append_events(verdicts.where("verdict = 'appended'").drop("verdict"), instances)
    return Received(verdicts, events, moved, wake_once(events.select("workflow_id"), tasks, ["workflow_id"]))


def history_of(history: DataFrame, keys: list[str], first: Column | None = None) -> DataFrame:
    """The events of workflows in order, from ``first`` on where it is given: filters reach the scan, and the order is each workflow's own."""
    found = history if first is None else history.where(F.col("sequence") >= first)
    return found.repartition(*keys).sortWithinPartitions(*keys, "sequence")


def instance_at(instances: DataFrame, tenant: str, namespace: str, workflow_id: object) -> DataFrame:
    """The one instance of an id, or no row: equality on the key reaches the scan."""
    return instances.where((F.col("tenant") == tenant) & (F.col("namespace") == namespace) & (F.col("workflow_id") == F.lit(workflow_id)))


def tails(claims: DataFrame, tasks: DataFrame, instances: DataFrame, history: DataFrame, epoch: int) -> DataFrame:
    """``(task_id, workflow_id, sequence, kind, verdict)``: the events that a claimed task has still to see.

    A task that isn't claimed under ``epoch`` has one row, StaleRuntimeEpoch; one without new events a row of nulls. A tail
    that doesn't go on from the last processed event without a gap is CorruptSchema in every row.
    """
    held = tasks.where((F.col("status") == "claimed") & (F.col("claimed_epoch") == epoch)).select("task_id", F.lit(True).alias("_held"))
    own = claims.select("task_id", "workflow_id").join(held, "task_id", "left").join(instances.select("workflow_id", "last_processed"), "workflow_id", "left")
    events = history.select("workflow_id", "sequence", "kind").join(own.where("_held").select("workflow_id", "last_processed"), "workflow_id").where("sequence > last_processed")
    w = Window.partitionBy("workflow_id")
    events = events.withColumn("_off", (F.col("sequence") != F.col("last_processed") + F.row_number().over(w.orderBy("sequence"))).cast("int"))
    events = events.withColumn("_off", F.max("_off").over(w)).drop("last_processed")
    verdict = F.when(F.col("_held").isNull(), "StaleRuntimeEpoch").when(F.col("_off") == 1, "CorruptSchema").otherwise("loaded")
    return own.join(events, "workflow_id", "left").select("task_id", "workflow_id", "sequence", "kind", verdict.alias("verdict"))


@dataclass(frozen=True)
class Committed:
    """What a batch of transitions comes to; ``notices`` are events for the parents of workflows that ended."""

    verdicts: DataFrame
    instances: DataFrame
    tasks: DataFrame
    notices: DataFrame


def commit_transitions(commits: DataFrame, instances: DataFrame, tasks: DataFrame, history: DataFrame, children: DataFrame, epoch: int) -> Committed:
    """Compare and set for a batch of transitions.

    ``commits``: arrival, task_id, workflow_id, epoch, state_version, definition_id, definition_version, state, status,
    last_processed, utc_ms. One of another epoch is a StaleRuntimeEpoch. One is committed if the instance has the state version and
    definition that it read and the task is still claimed under the epoch; the first of a workflow wins, all else is a Conflict.
    The task is ready again if there are events behind the last processed one, else completed. Parents (``children``:
    parent_id, workflow_id, notified) of workflows that ended get one event of their child.
    """
    now = instances.selectExpr("workflow_id", "state_version as _v", "definition_id as _d", "definition_version as _dv")
    held = tasks.where((F.col("status") == "claimed") & (F.col("claimed_epoch") == epoch)).select("task_id", "workflow_id", F.lit(True).alias("_held"))
    met = commits.join(now, "workflow_id", "left").join(held, ["task_id", "workflow_id"], "left")
    fits = (F.col("epoch") == epoch) & F.col("_held").isNotNull() & (F.col("state_version") == F.col("_v")) & (F.col("definition_id") == F.col("_d")) & (F.col("definition_version") == F.col("_dv"))
    met = met.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("workflow_id", "_fits").orderBy("arrival")) == 1
    verdict = F.when(F.col("epoch") != epoch, "StaleRuntimeEpoch").when(F.col("_fits") & first, "committed").otherwise("Conflict")
    verdicts = met.withColumn("verdict", verdict).select(*commits.columns, "verdict")
    done = verdicts.where("verdict = 'committed'")

    new = done.selectExpr("workflow_id", "state as _state", "status as _status", "last_processed as _last", "utc_ms as _at")
    moved = instances.join(new, "workflow_id", "left").withColumns(
        {
            "state_version": F.col("state_version") + F.col("_status").isNotNull().cast("int"),
            "state": F.when(F.col("_status").isNotNull(), F.col("_state")).otherwise(F.col("state")),
            "status": F.coalesce("_status", "status"),
            "last_processed": F.coalesce("_last", "last_processed"),
            "updated_ms": F.coalesce("_at", "updated_ms"),
        }
    )
    last = history.join(done.select("workflow_id"), "workflow_id", "left_semi").groupBy("workflow_id").agg(F.max("sequence").alias("_most"))
    next_ = done.selectExpr("task_id", "workflow_id", "last_processed as _last", "utc_ms as _at").join(last, "workflow_id", "left").drop("workflow_id")
    more = F.coalesce(F.col("_most") > F.col("_last"), F.lit(False))
    after = tasks.join(next_, "task_id", "left").withColumns(
        {
            "status": F.when(F.col("_last").isNull(), F.col("status")).when(more, "ready").otherwise("completed"),
            "available_ms": F.coalesce("_at", "available_ms"),
            "claimed_epoch": F.when(F.col("_last").isNull(), F.col("claimed_epoch")),
        }
    )
    kind = F.when(F.col("status") == "completed", EVENTS["child_completed"]).when(F.col("status") == "failed", EVENTS["child_failed"]).otherwise(EVENTS["child_cancelled"])
    ended = done.where(F.col("status").isin(*TERMINAL)).select("workflow_id", kind.alias("kind"), "utc_ms", "arrival")
    notices = children.where("not notified").join(ended, "workflow_id").selectExpr("parent_id as workflow_id", "workflow_id as child_id", "kind", "utc_ms", "arrival")
    return Committed(verdicts, moved.select(*instances.columns), after.select(*tasks.columns), notices)


def activity_failures(tasks: DataFrame, now: Column) -> DataFrame:
    """``tasks`` with ``failure`` and ``code``, null while an activity may go on.

    In this order: nothing is registered under its name; its input has another schema; it waited too long; no executor
    takes it; the worker shuts down; it is to be cancelled; it ran too long; it gave no sign too long; its output has
    another schema. A limit is reached when as much time has passed. Columns: registered, schema_id, input_schema_id,
    scheduled_ms, started_ms, heartbeat_ms, the limits, executor_available, shutdown, cancel_requested,
    output_schema_id, expected_output_schema_id; null limits never end.
    """
    passed = lambda since, limit: F.coalesce(now - F.col(since) >= F.col(limit), F.lit(False))
    running = F.col("started_ms").isNotNull()
    failure = (
        F.when(~F.col("registered"), "unregistered_activity")
        .when(F.col("schema_id") != F.col("input_schema_id"), "input_schema_mismatch")
        .when(~running & passed("scheduled_ms", "schedule_to_start_ms"), "schedule_to_start_timeout")
        .when(~F.col("executor_available"), "executor_unavailable")
        .when(running & F.col("shutdown"), "shutdown")
        .when(running & F.col("cancel_requested"), "cancelled")
        .when(running & passed("started_ms", "start_to_close_ms"), "start_to_close_timeout")
        .when(running & F.coalesce(now - F.coalesce("heartbeat_ms", "started_ms") >= F.col("heartbeat_timeout_ms"), F.lit(False)), "heartbeat_timeout")
        .when(F.col("output_schema_id") != F.col("expected_output_schema_id"), "output_schema_mismatch")
    )
    codes = F.create_map(*(F.lit(x) for pair in ACTIVITY_CODES.items() for x in pair))
    return tasks.withColumn("failure", failure).withColumn("code", codes[F.col("failure")])


def _of_epoch(requests: DataFrame, tasks: DataFrame, epoch: int) -> DataFrame:
    """``requests`` with ``_held``: whether the task is claimed under the current epoch, which must be the request's own; the first request of a task counts."""
    held = tasks.where((F.col("status") == "claimed") & (F.col("claimed_epoch") == epoch)).select("task_id", F.lit(True).alias("_there"))
    met = requests.join(held, "task_id", "left")
    fits = F.coalesce((F.col("epoch") == epoch) & F.col("_there"), F.lit(False))
    met = met.withColumn("_fits", fits)
    return met.withColumn("_held", F.col("_fits") & (F.row_number().over(Window.partitionBy("task_id", "_fits").orderBy("arrival")) == 1)).drop("_there", "_fits")


def finish_activities(results: DataFrame, tasks: DataFrame, instances: DataFrame, workflow_tasks: DataFrame, epoch: int) -> tuple[Received, DataFrame]:
    """Results (arrival, task_id, workflow_id, epoch, kind, utc_ms, payload) become events of running workflows, which wake; the tasks as they then are come second.

    A result whose claim is gone is a StaleRuntimeEpoch, one for a workflow that has ended NotFound; neither changes anything.
    """
    met = _of_epoch(results, tasks, epoch).join(instances.selectExpr("workflow_id", "status as _status"), "workflow_id", "left")
    verdict = F.when(~F.col("_held"), "StaleRuntimeEpoch").when(F.coalesce(F.col("_status") == "running", F.lit(False)), "finished").otherwise("NotFound")
    verdicts = met.withColumn("verdict", verdict).select(*results.columns, "verdict")
    done = verdicts.where("verdict = 'finished'")
    events, moved = append_events(done.drop("verdict"), instances)
    after = tasks.join(done.select("task_id", F.lit(True).alias("_done")), "task_id", "left").withColumn("status", F.when(F.col("_done"), "completed").otherwise(F.col("status")))
    return Received(verdicts, events, moved, wake_once(events.select("workflow_id"), workflow_tasks, ["workflow_id"])), after.select(*tasks.columns)


def heartbeats(beats: DataFrame, tasks: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
    """``beats`` (arrival, task_id, epoch, utc_ms) with ``verdict``, and the tasks with their latest sign of life."""
    held = tasks.where((F.col("status") == "claimed") & (F.col("claimed_epoch") == epoch)).select("task_id", F.lit(True).alias("_held"))
    told = beats.join(held, "task_id", "left").withColumn("verdict", F.when(F.col("_held") & (F.col("epoch") == epoch), "beaten").otherwise("StaleRuntimeEpoch")).drop("_held")
    last = told.where("verdict = 'beaten'").groupBy("task_id").agg(F.max("utc_ms").alias("_at"))
    after = tasks.join(last, "task_id", "left").withColumn("heartbeat_ms", F.greatest("heartbeat_ms", "_at")).select(*tasks.columns)
    return told.select(*beats.columns, "verdict"), after


def retry_activities(retries: DataFrame, tasks: DataFrame, instances: DataFrame, epoch: int) -> tuple[Received, DataFrame]:
    """Claims (arrival, task_id, workflow_id, epoch, attempt, delay_ms, utc_ms) given back: ready after the delay, with an event that tells attempt and delay."""
    verdicts = _of_epoch(retries, tasks, epoch).withColumn("verdict", F.when(F.col("_held"), "retried").otherwise("StaleRuntimeEpoch")).select(*retries.columns, "verdict")
    done = verdicts.where("verdict = 'retried'")
    payload = F.concat(big_endian(F.col("attempt"), 4), big_endian(F.col("delay_ms"), 8))
    events, moved = append_events(done.drop("verdict").withColumns({"kind": F.lit(EVENTS["activity_retry_scheduled"]), "payload": payload}), instances)
    back = done.select("task_id", (F.col("utc_ms") + F.col("delay_ms")).alias("_at"))
    after = tasks.join(back, "task_id", "left").withColumns(
        {"status": F.when(F.col("_at").isNotNull(), "ready").otherwise(F.col("status")), "available_ms": F.coalesce("_at", "available_ms"), "claimed_epoch": F.when(F.col("_at").isNull(), F.col("claimed_epoch"))}
    )
    return Received(verdicts, events, moved, wake_once(events.select("workflow_id").limit(0), tasks, ["workflow_id"])), after.select(*tasks.columns)


def cancelled_activities(claims: DataFrame, history: DataFrame) -> DataFrame:
    """``claims`` with ``cancelled``: whether their workflow's history holds a request to cancel."""
    asked = history.where(F.col("kind") == EVENTS["cancellation_requested"]).select("workflow_id").distinct().withColumn("cancelled", F.lit(True))
    return claims.join(asked, "workflow_id", "left").withColumn("cancelled", F.coalesce("cancelled", F.lit(False)))


@dataclass(frozen=True)
class Acted:
    """What a batch of operators' requests comes to: verdicts, rows for the ledger, and the changed tables."""

    verdicts: DataFrame
    ledger: DataFrame
    events: DataFrame
    instances: DataFrame
    tasks: DataFrame
    wakes: DataFrame


def operate(requests: DataFrame, ledger: DataFrame, instances: DataFrame, tasks: DataFrame) -> Acted:
    """Operators' requests to terminate, cancel or retry workflows, each under a key in a ledger.

    ``requests``: tenant, namespace, workflow_id, principal, action, reason, idempotency_key, authorized, request_hash,
    utc_ms, arrival; ``ledger``: tenant, namespace, principal, action, idempotency_key, authorized, request_hash, result, error.
    Without principal, reason or key: Unauthorized, and nothing is kept; too long ones: PayloadTooLarge. A key that is in the ledger,
    or came earlier in the batch, tells its result again (repeated, or its error) if hash and authority agree, else
    IdempotencyConflict. New ones are written to the ledger: unauthorized ones as failed; a request for an unknown workflow is
    NotFound and not kept; terminating what has ended, or was ended by an earlier request of the batch, fails with Conflict. Terminated
    workflows are cancelled with an event, their tasks completed; cancelling appends a request and wakes; retrying completes blocked tasks and wakes.
    """
    key = [*SCOPE, "principal", "action", "idempotency_key"]
    empty = F.greatest(*(F.coalesce(F.length(c) == 0, F.lit(True)).cast("int") for c in LONGEST)) == 1
    long_ = F.greatest(*((F.octet_length(c) > most).cast("int") for c, most in LONGEST.items())) == 1
    past = ledger.select(*key, F.col("authorized").alias("_auth"), F.col("request_hash").alias("_hash"), F.col("result").alias("_result"), F.col("error").alias("_error"))
    met = requests.join(past, key, "left").join(instances.selectExpr("workflow_id", "status as _status"), "workflow_id", "left")
    met = met.withColumn("_refused", F.when(empty, "Unauthorized").when(long_, "PayloadTooLarge"))
    fresh = F.col("_refused").isNull() & F.col("_result").isNull()
    met = met.withColumn("_fresh", fresh)
    w = Window.partitionBy(*key, "_fresh").orderBy("arrival")
    met = met.withColumn("_first", F.col("_fresh") & (F.row_number().over(w) == 1))
    # of first requests that terminate a running workflow the earliest wins
    ends = F.col("_first") & F.col("authorized") & (F.col("action") == "terminate") & F.coalesce(F.col("_status") == "running", F.lit(False))
    earlier = F.sum(ends.cast("int")).over(Window.partitionBy("workflow_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("_ended", F.coalesce(earlier, F.lit(0)) > 0)
    stopped = (F.col("_status") != "running") | F.col("_ended")
    own = (
        F.when(~F.col("authorized"), F.struct(F.lit("failed").alias("result"), F.lit("Unauthorized").alias("error")))
        .when(F.col("_status").isNull(), F.struct(F.lit("none").alias("result"), F.lit("NotFound").alias("error")))
        .when((F.col("action") == "terminate") & stopped, F.struct(F.lit("failed").alias("result"), F.lit("Conflict").alias("error")))
        .otherwise(F.struct(F.lit("succeeded").alias("result"), F.lit(None).cast("string").alias("error")))
    )
    met = met.withColumn("_own", F.when(F.col("_first"), own))
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_first = lambda c: F.first(F.when(F.col("_first"), F.col(c)), ignorenulls=True).over(all_)
    met = met.withColumns(
        {"_auth": F.coalesce("_auth", of_first("authorized")), "_hash": F.coalesce("_hash", of_first("request_hash")), "_result": F.coalesce("_result", of_first("_own.result")), "_error": F.coalesce("_error", of_first("_own.error"))}
    )
    agrees = F.col("_hash").eqNullSafe(F.col("request_hash")) & F.col("_auth").eqNullSafe(F.col("authorized"))
    verdict = (
        F.when(F.col("_refused").isNotNull(), F.col("_refused"))
        .when(F.col("_first"), F.coalesce("_own.error", F.lit("done")))
        .when(~agrees, "IdempotencyConflict")
        .when(F.col("_result") == "succeeded", "repeated")
        .otherwise(F.coalesce("_error", F.lit("Conflict")))
    )
    told = met.withColumn("verdict", verdict)
    rows = told.where("_first and _own.result <> 'none'").selectExpr(*key, "authorized", "request_hash", "_own.result as result", "_own.error as error")
    done = told.where("verdict = 'done'").select(*requests.columns)
    kind = F.when(F.col("action") == "terminate", EVENTS["workflow_terminated"]).when(F.col("action") == "cancel", EVENTS["cancellation_requested"])
    events, moved = append_events(done.withColumn("kind", kind).where("kind is not null"), instances)
    ended = done.where("action = 'terminate'").select("workflow_id", F.lit(True).alias("_ended")).distinct()
    retried = done.where("action = 'retry'").select("workflow_id", F.lit(True).alias("_retried")).distinct()
    moved = moved.join(ended, "workflow_id", "left").withColumn("status", F.when(F.col("_ended"), "cancelled").otherwise(F.col("status"))).select(*instances.columns)
    closes = F.coalesce(F.col("_ended"), F.lit(False)) | (F.coalesce(F.col("_retried"), F.lit(False)) & (F.col("status") == "blocked"))
    after = tasks.join(ended, "workflow_id", "left").join(retried, "workflow_id", "left").withColumn("_closes", closes)
    after = after.withColumns({"status": F.when(F.col("_closes"), "completed").otherwise(F.col("status")), "claimed_epoch": F.when(~F.col("_closes"), F.col("claimed_epoch"))}).select(*tasks.columns)
    wakes = wake_once(done.where("action <> 'terminate'").select("workflow_id"), after, ["workflow_id"])
    return Acted(told.select(*requests.columns, "verdict"), rows, events.select(*requests.columns, "kind", "sequence"), moved, after, wakes)


def commit_archives(requests: DataFrame, instances: DataFrame, history: DataFrame, retention_before_ms: int) -> tuple[DataFrame, DataFrame]:
    """``requests`` (workflow_id, first, last, events) with ``verdict``, and the hot history without what was archived.

    Archived is a range of a workflow that has ended and not changed since ``retention_before_ms``, if the hot history has exactly
    these events in it; all else is a Conflict and stays.
    """
    old = instances.where((F.col("status") != "running") & (F.col("updated_ms") <= retention_before_ms)).select("workflow_id", F.lit(True).alias("_old"))
    met = requests.join(history.select("workflow_id", "sequence"), "workflow_id").where("sequence between first and last")
    got = met.groupBy("workflow_id", "first", "last").agg(F.count("*").alias("_n"), F.min("sequence").alias("_a"), F.max("sequence").alias("_b"))
    both = requests.join(got, ["workflow_id", "first", "last"], "left").join(old, "workflow_id", "left")
    fits = F.col("_old") & (F.col("_n") == F.col("events")) & (F.col("_a") == F.col("first")) & (F.col("_b") == F.col("last"))
    verdicts = both.withColumn("verdict", F.when(F.coalesce(fits, F.lit(False)), "archived").otherwise("Conflict")).select(*requests.columns, "verdict")
    gone = verdicts.where("verdict = 'archived'").selectExpr("workflow_id as _w", "first as _first", "last as _last")
    left = history.join(gone, (F.col("workflow_id") == F.col("_w")) & F.col("sequence").between(F.col("_first"), F.col("_last")), "left_anti")
    return verdicts, left


def manifests_of(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """Archives of each workflow in the order of their events, with their place among them."""
    return manifests.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first")).cast("long"))


def composed_verdicts(archived: DataFrame, hot: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``(*keys, events, verdict)``: whether archives and the hot tail make one history from 1 on without gap or repeat, of at most ``most`` events."""
    both = archived.select(*keys, "sequence").unionByName(hot.select(*keys, "sequence"))
    seen = both.groupBy(*keys).agg(F.count("*").alias("events"), F.min("sequence").alias("_a"), F.max("sequence").alias("_b"), F.count_distinct("sequence").alias("_d"))
    whole = (F.col("_a") == 1) & (F.col("_b") == F.col("events")) & (F.col("_d") == F.col("events"))
    verdict = F.when(~whole, "InvalidSequence").when(F.col("events") > most, "ReplayLimitExceeded").otherwise("whole")
    return seen.select(*keys, "events", verdict.alias("verdict"))


def snapshot_hash(workflow_id: Column, sequence: Column, version: Column, state: Column) -> Column:
    """The checksum of a saved state: the hash of 16 bytes of id, sequence and version, mixed with that of the state."""
    return fnv(F.concat(workflow_id, big_endian(sequence, 8), big_endian(version, 4))).bitwiseXOR(fnv(F.coalesce(state.cast("binary"), F.lit(b""))))


def save_snapshots(saved: DataFrame, new: DataFrame) -> DataFrame:
    """``saved`` with ``new`` (workflow_id, event_sequence, definition_version, state, checksum): one of an id and sequence replaces what was there; those whose checksum is wrong stay out."""
    right = new.where(F.col("checksum") == snapshot_hash(F.col("workflow_id"), F.col("event_sequence"), F.col("definition_version"), F.col("state")))
    tagged = saved.withColumn("_n", F.lit(0)).unionByName(right.withColumn("_n", F.lit(1)))
    rest = ["definition_version", "state", "checksum"]
    best = tagged.groupBy("workflow_id", "event_sequence").agg(F.max_by(F.struct(*rest), "_n").alias("_b"))
    return best.select("workflow_id", "event_sequence", *(f"_b.{c}" for c in rest))


@dataclass(frozen=True)
class Migrated:
    verdicts: DataFrame
    instances: DataFrame
    events: DataFrame
    tasks: DataFrame
    snapshots: DataFrame
    wakes: DataFrame


def migrate_definitions(requests: DataFrame, instances: DataFrame, tasks: DataFrame, steps: dict[int, Callable[[Column], Column]], target: int) -> Migrated:
    """Running workflows brought to definition version ``target``, one step a version, each step a column expression over the state.

    ``requests``: workflow_id, utc_ms, arrival. No running workflow: Conflict; a version without a step on the way, or beyond the
    target: MigrationFailed; both change nothing. Claimed tasks are blocked first, an event marks the change, the new state is
    saved with the marker's sequence, and the workflow wakes.
    """
    now = instances.where("status = 'running'").select("workflow_id", F.col("definition_version").alias("_from"), F.col("state").alias("_state"))
    met = requests.join(now, "workflow_id", "left")
    lowest = target
    while lowest - 1 in steps:
        lowest -= 1
    first = F.row_number().over(Window.partitionBy("workflow_id").orderBy("arrival")) == 1
    verdict = F.when(F.col("_from").isNull() | ~first, "Conflict").when(F.col("_from").between(lowest, target), "migrated").otherwise("MigrationFailed")
    told = met.withColumn("verdict", verdict)
    done = told.where("verdict = 'migrated'")
    state = F.col("_state")
    for version in range(lowest, target):
        state = F.when(F.col("_from") <= version, steps[version](state)).otherwise(state)
    done = done.withColumn("_new", state)
    events, moved = append_events(done.select(*requests.columns).withColumn("kind", F.lit(EVENTS["definition_migrated"])), instances)
    new = done.select("workflow_id", "_new", F.lit(target).alias("_target"))
    moved = moved.join(new, "workflow_id", "left").withColumns({"state": F.when(F.col("_target").isNotNull(), F.col("_new")).otherwise(F.col("state")), "definition_version": F.coalesce("_target", "definition_version")}).select(*instances.columns)
    fenced = tasks.join(new.select("workflow_id", F.lit(True).alias("_hit")), "workflow_id", "left")
    fenced = fenced.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "claimed"), "blocked").otherwise(F.col("status"))).select(*tasks.columns)
    saved = events.select("workflow_id", F.col("sequence").alias("event_sequence")).join(done.select("workflow_id", F.col("_new").alias("state")), "workflow_id").withColumn("definition_version", F.lit(target))
    return Migrated(told.select(*requests.columns, "verdict"), moved, events, fenced, saved, wake_once(new.select("workflow_id"), fenced, ["workflow_id"]))


def backfill_steps(steps: DataFrame, plans: DataFrame, activities: DataFrame) -> DataFrame:
    """Compensation steps (plan_id, step_index, payload, schema_id) with the task that ran them: of their plan's workflow's activities with the same payload and schema the one of the greatest command."""
    of_plan = steps.select("plan_id", "step_index", "payload", "schema_id").join(plans.select("plan_id", "workflow_id"), "plan_id")
    found = of_plan.join(activities.select("workflow_id", "payload", "schema_id", "task_id", "command_sequence"), ["workflow_id", "payload", "schema_id"])
    best = found.groupBy("plan_id", "step_index").agg(F.max_by(F.struct("task_id", "command_sequence"), F.struct("command_sequence", "task_id")).alias("_b"))
    return steps.join(best.select("plan_id", "step_index", "_b.task_id", "_b.command_sequence"), ["plan_id", "step_index"], "left")


def backfill_activities(activities: DataFrame, steps: DataFrame) -> DataFrame:
    """Activities with the plan and step that they run; open ones of a plan are completed but for the highest step that is pending or running."""
    own = steps.where("task_id is not null").groupBy("task_id").agg(F.min_by(F.struct("plan_id", "step_index"), F.struct("plan_id", "step_index")).alias("_s")).select("task_id", "_s.plan_id", "_s.step_index")
    top = steps.where("status in ('pending', 'running')").groupBy("plan_id").agg(F.max("step_index").alias("_top"))
    both = activities.join(own, "task_id", "left").join(top, "plan_id", "left")
    stops = F.col("status").isin("ready", "claimed") & (F.col("step_index") != F.col("_top"))
    return both.withColumn("status", F.when(F.coalesce(stops, F.lit(False)), "completed").otherwise(F.col("status"))).select(*activities.columns, "plan_id", "step_index")


def backfill_ledger(ledger: DataFrame) -> DataFrame:
    """Ledger rows from before results were kept: authorized ones succeeded, the others failed for that."""
    return ledger.withColumns({"result": F.when(F.col("authorized"), "succeeded").otherwise("failed"), "error": F.when(~F.col("authorized"), "Unauthorized")})


class Recorded:
    """What a Python transition may use besides its event: recorded random values, in order, and a bounded list of commands.

    Values that run out are an error, as a replay must see what the first run saw; a command beyond the capacity is one too.
    """

    def __init__(self, random_values: list[int], capacity: int) -> None:
        self.random_values, self.capacity, self.used = random_values, capacity, 0
        self.commands: list[tuple[int, str, bytes]] = []

    def next_random(self) -> int:
        if self.used == len(self.random_values):
            raise LookupError("MissingRecordedRandom")
        self.used += 1
        return self.random_values[self.used - 1]

    def emit(self, kind: str, payload: bytes) -> None:
        if len(self.commands) == self.capacity:
            raise OverflowError("CommandCapacityExceeded")
        self.commands.append((len(self.commands) + 1, kind, payload))


def draws(history: DataFrame, keys: list[str], recorded: DataFrame) -> DataFrame:
    """Each draw (keys, draw from 1 on) with the recorded value (keys, values: array) of its number, or MissingRecordedRandom as ``error``."""
    met = history.join(recorded, keys, "left")
    value = F.get(F.col("values"), F.col("draw").cast("int") - 1)
    return met.withColumn("value", value).withColumn("error", F.when(value.isNull(), "MissingRecordedRandom")).drop("values")


def over_capacity(commands: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """Decisions that emit more commands than fit, or don't number them from 1 on without a gap: ``(*keys, n, error)``."""
    seen = commands.groupBy(*keys).agg(F.count("*").alias("n"), F.min("sequence").alias("_a"), F.max("sequence").alias("_b"), F.count_distinct("sequence").alias("_d"))
    error = F.when(F.col("n") > capacity, "CommandCapacityExceeded").when((F.col("_a") != 1) | (F.col("_b") != F.col("n")) | (F.col("_d") != F.col("n")), "InvalidSequence")
    return seen.withColumn("error", error).where("error is not null").select(*keys, "n", "error")
