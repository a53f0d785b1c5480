"""Content hashes: 64-bit FNV-1a over binary columns in Arrow batches, and SHA-256 fingerprints of framed fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed values of the hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(data: bytes) -> int:
    """The unsigned hash of one value."""
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64_many(values: list[bytes | None]) -> np.ndarray:
    """Unsigned hashes of many values: rows advance together, a byte position at a time; null hashes as empty."""
    raw = [v or b"" for v in values]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(raw), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(raw) else size
    with np.errstate(over="ignore"):
        for at in range(int(size.max(initial=0))):
            rows = order[: np.searchsorted(-size[order], -at, "left")]
            h[rows] = (h[rows] ^ flat[start[rows] + at]) * np.uint64(FNV_PRIME)
    return h


@F.pandas_udf(LongType())
def _fnv(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in values:
        yield pd.Series(fnv1a64_many([bytes(v) if v is not None else None for v in part]).view(np.int64))


def fnv(column: Column | str) -> Column:
    """The hash's bits as a signed long."""
    return _fnv(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary"))


def framed(column: Column | str) -> Column:
    """A field behind its length as eight bytes, big-endian: what fingerprints are made of."""
    raw = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("binary"), F.lit(b""))
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)


def big_endian(column: Column, width: int) -> Column:
    """A non-negative integer column as ``width`` bytes."""
    return F.unhex(F.lpad(F.hex(column.cast("long")), 2 * width, "0"))


def fingerprint(kind: Column, version: Column, params: Column, inputs: list[tuple[Column, Column]], toolchain: Column, environment: list[tuple[str, Column]]) -> Column:
    """SHA-256, as hex digits, over a task's kind, version, parameters, input versions and hashes, toolchain and environment.

    Environment names must be given in strictly ascending order. All native: the plan has no Python.
    """
    names = [n for n, _ in environment]
    if any(a >= b for a, b in zip(names, names[1:])):
        raise ValueError("environment names must be strictly sorted")
    parts = [framed(kind), big_endian(version, 4), framed(params), F.unhex(F.lit(f"{len(inputs):016x}"))]
    for v, h in inputs:
        parts += [big_endian(v, 8), big_endian(h, 8)]
    parts.append(framed(toolchain))
    for name, value in environment:
        parts += [framed(F.lit(name)), framed(value)]
    return F.sha2(F.concat(*parts), 256)


@F.pandas_udf(LongType())
def _replay_checksum(logs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    mask = (1 << 64) - 1
    for part in logs:
        out = []
        for log in part:
            h = FNV_OFFSET
            for number in log if log is not None else ():
                h = (h ^ (int(number) & mask)) * FNV_PRIME & mask
            out.append(h - (1 << 64) if h >> 63 else h)
        yield pd.Series(out, dtype="int64")


def replay_checksum(kinds: Column, tasks: Column) -> Column:
    """The checksum of an ordered log of events, given as arrays of kinds and task ids: both numbers of each event are mixed in whole."""
    pairs = F.flatten(F.transform(F.arrays_zip(kinds.alias("k"), tasks.alias("t")), lambda e: F.array(e["k"].cast("long"), e["t"].cast("long"))))
    return _replay_checksum(pairs)


def generational(index: Column, generation: Column) -> Column:
    """An id's text; the greatest index stands for no id."""
    return F.when(index == 0xFFFFFFFF, "invalid").otherwise(F.concat_ws(":", index.cast("string"), generation.cast("string")))


def generational_order(index: Column, generation: Column) -> Column:
    """What ids are ordered by: the slot, then how often it was used."""
    return F.struct(index.alias("index"), generation.alias("generation"))
