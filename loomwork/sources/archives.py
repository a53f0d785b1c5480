"""History archives as binary columns: packed a workflow at a time, unpacked row by row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.codecs import ArchiveRecord, pack_archive, unpack_archive

ROW = "sequence long, kind long, utc_ms long, schema_id long, schema_version long, payload binary"


def pack(history: DataFrame, key: str, schema_id: int = 0, schema_version: int = 1) -> DataFrame:
    """``(key, archive)`` of rows (sequence, kind, utc_ms, payload). A group is one workflow's history; a gap in it is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("sequence")
        records = [ArchiveRecord(int(r.sequence), int(r.kind), int(r.utc_ms), schema_id, schema_version, bytes(r.payload or b"")) for r in rows.itertuples(index=False)]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "archive": [pack_archive(records)]})

    columns = history.select(key, "sequence", "kind", "utc_ms", "payload")
    return columns.groupBy(key).applyInPandas(run, f"{key} {history.schema[key].dataType.simpleString()}, archive binary")


def unpack(archives: DataFrame, key: str) -> DataFrame:
    """A row per record of each archive; a harmed archive is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                found = unpack_archive(raw)
                columns = [pa.array([getattr(r, name) for r in found], kind) for name, kind in (("sequence", pa.int64()), ("kind", pa.int64()), ("utc_ms", pa.int64()), ("schema_id", pa.int64()), ("schema_version", pa.int64()), ("payload", pa.binary()))]
                own = pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([own, *columns], [key, *(x.split(" ")[0] for x in ROW.split(", "))])

    return archives.select(key, "archive").mapInArrow(run, f"{key} {archives.schema[key].dataType.simpleString()}, {ROW}")
