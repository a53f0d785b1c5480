"""What the training-data operators share: shared-folder storage, lineage cuts, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder's URI below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a finished write at once where this is set; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once all that reads it is written itself."""
    for df in written:
        remove(df.sparkSession, df._written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, as ``doc_id`` and ``text``; other columns, whatever their names, stay out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of at most ``rows`` rows, so that Python objects of few texts exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches: Iterable[pa.RecordBatch], rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same, and pieces of more than ``most`` bytes are halved down to single rows."""
    for part in slices(batches, rows):
        todo = [part]
        while todo:
            own = todo.pop()
            if own.num_rows > 1 and own.nbytes > most:
                half = own.num_rows // 2
                todo += [own.slice(half), own.slice(0, half)]
            else:
                yield own


def spread(spark: SparkSession) -> int:
    """Number of partitions for a shuffle: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def open_store(uri: str):
    """``(filesystem, path)`` for a URI of the shared store; executors write and read raw files through it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))
