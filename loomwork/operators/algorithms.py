"""Parallel data algorithms over rows with an explicit unique order: map, invoke, reduce, scans, sorts, bounded pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_root


def for_range(spark: SparkSession, start: int, end: int, body: Callable[[pd.Series], pd.DataFrame], schema: str, partitions: int | None = None) -> DataFrame:
    """``body`` over the ids of a half-open range, in batches. The first error fails the job and cancels the rest."""
    if end < start:
        raise ValueError("a range can't end before its start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield body(batch["id"])

    return spark.range(start, end, 1, partitions).mapInPandas(run, schema)


def invoke(functions: list[Callable[[], Any]], threads: int = 8) -> list[Any]:
    """Results of independent driver functions, each of which may start Spark jobs; the first error is raised after all have ended."""
    with ThreadPoolExecutor(max(1, min(threads, len(functions) or 1))) as pool:
        return [x.result() for x in [pool.submit(f) for f in functions]]


def reduce_builtin(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row of built-in aggregates: combined in each task, then once."""
    return df.agg(*(c.alias(name) for name, c in aggregates.items()))


def reduce_ordered(df: DataFrame, order: str, value: str, initial: Any, combine: Callable[[Any, Any], Any], partitions: int | None = None) -> Any:
    """Fold of an associative ``combine`` in the order of ``order``, ``initial`` applied once.

    Ranges of the order are folded where they lie; a partial per range reaches the driver, not the rows.
    """
    ranged = df.select(F.col(order).alias("k"), F.col(value).alias("x"))
    ranged = (ranged.repartitionByRange(partitions, "k") if partitions else ranged.repartitionByRange("k")).sortWithinPartitions("k").select("x", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, None
        for batch in batches:
            for x, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, part = (x if part is None else combine(total, x)), p
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "x": pa.array([total])})

    kind = df.schema[value].dataType.simpleString()
    out = initial
    for row in sorted(ranged.mapInArrow(run, f"part int, x {kind}").collect()):  # a row per range
        out = combine(out, row["x"])
    return out


def scan_within(df: DataFrame, keys: list[str], order: str, value: str, name: str, exclusive: bool = False, initial: int = 0) -> DataFrame:
    """Running sums within keys. Exclusive: what is before a row, from ``initial`` on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    total = F.sum(value).over(w)
    return df.withColumn(name, F.coalesce(total, F.lit(0)) + initial if exclusive else total)


def scan_global(df: DataFrame, order: str, value: str, name: str, exclusive: bool = False, initial: int = 0, partitions: int | None = None) -> DataFrame:
    """Running sum over the whole table in two passes, without a single-task window.

    Rows are ranged by ``order`` and written with the range's number: totals per range are summed (a row per range), and
    the sum before a range is added to each row's sum within it. ``order`` must be unique.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    # the ranges must not be drawn anew between the two reads
    shared_root(spark)
    ranged = ranged.checkpoint()
    before = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = before.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    joined = ranged.join(F.broadcast(before), "_part").withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("_before") + (initial if exclusive else 0))
    return joined.drop("_part", "_before")


def number_global(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 1 on in an order over the whole table, without a single-task window: places within ranges and the number of rows before each range. The order must be unique."""
    spark = df.sparkSession
    shared_root(spark)
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).checkpoint()
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")


def percentile_pick(df: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """``(*keys, value)``: of each key's values in order the one at n * percent / 100, counted from 0, rounded down, the last at most."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value).withColumns({"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") == F.least(F.col("_n") - 1, F.expr(f"(_n * {percent}) div 100"))).select(*keys, value)


def sort_stable(df: DataFrame, keys: list[Column], original: str) -> DataFrame:
    """Sorted by ``keys``; equal rows stay in the order of the unique column ``original``."""
    return df.orderBy(*keys, original)


def sort_unstable(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.orderBy(*keys)


def pipeline(df: DataFrame, consume: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A consumer that pulls batches in order from its partition: it holds what it asked for and no more."""
    return df.mapInArrow(consume, schema)
