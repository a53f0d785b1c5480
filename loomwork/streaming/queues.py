"""Durable queues as Structured Streaming: inbox de-duplication, folded states, outbox publication. All restart from their checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def inbox(messages: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each message once. With a watermark (column, delay) its state is bounded; without one every id is remembered."""
    if watermark:
        return messages.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return messages.dropDuplicates(keys)


def firsts(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's earliest row of the first micro-batch that has it, once: what was delivered is held as keyed state, so no batch reads earlier output."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in (*keys, order)}

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.exists:
            return
        least = min(part[order].min() for part in parts)
        held.update((True,))
        yield pd.DataFrame([(*key, least)], columns=[*keys, order])

    return messages.groupBy(*keys).applyInPandasWithState(step, ", ".join(f"{c} {t}" for c, t in kinds.items()), "seen boolean", "append", GroupStateTimeout.NoTimeout)


def run_inbox(spark: SparkSession, path: str, root: str, keys: list[str], order: str, folder: str | None = None) -> DataFrame:
    """De-duplicate a table as a stream, once through what is there, into the shared folder; run again, it goes on.

    Of the repeats in a micro-batch the earliest by ``order`` wins; what an earlier batch delivered stays. A batch that runs again replaces its own part.
    """
    folder = folder or f"{root}/inbox-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # a table may be one file or a folder of files: the parent folder is watched, and the name filtered
    parent, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    fresh = firsts(stream.select(*keys, order), keys, order)
    out = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in (*keys, order))
    query = fresh.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def fold_stream(events: DataFrame, key: str, transition: Callable[[str, dict[str, Any]], str], initial: str) -> DataFrame:
    """``(key, state, events)`` after each micro-batch for keys that had events (sequence, kind): the state machine as a stream."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, n, last = held.get if held.exists else (initial, 0, -1)
        rows = pd.concat(list(parts)).sort_values("sequence")
        for row in rows.to_dict("records"):
            if row["sequence"] <= last:
                continue  # delivered before
            state, n, last = transition(state, row), n + 1, row["sequence"]
        held.update((state, n, last))
        yield pd.DataFrame({key: [k[0]], "state": [state], "events": [n]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, events long", "state string, events long, last long", "update", GroupStateTimeout.NoTimeout)


def publish(outbox: DataFrame, send: Callable[[pd.DataFrame], None], checkpoint: str):
    """Send each message of a stream at least once; ``send`` must be idempotent by message_id. Returns the running query."""

    def each(batch: DataFrame, epoch: int) -> None:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                send(part)
                yield part[["message_id"]]

        kind = batch.schema["message_id"].dataType.simpleString()
        batch.mapInPandas(run, f"message_id {kind}").write.format("noop").mode("overwrite").save()

    return outbox.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_timers(timers: DataFrame, now: F.Column) -> DataFrame:
    """Timers of a stream that are due at an injected time: a filter, so batch and stream agree."""
    return timers.where((F.col("status") == "scheduled") & (F.col("fire_at") <= now))
