"""Scalar rules as column expressions: change ticks, retries, moving means, histogram places, chunk geometry, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS = 1 << 32

#: Stable error codes and the class of failure that each belongs to.
ERROR_CLASS = {
    0: "none", 1: "caller", 2: "caller", 3: "caller", 4: "cancelled", 5: "transient", 6: "transient", 7: "transient", 8: "corruption", 9: "permanent", 10: "caller", 11: "caller",
}


def is_newer(value: Column, cursor: Column) -> Column:
    """Whether a wrapping 32-bit tick is after another: less than half the ring ahead."""
    ahead = F.pmod(value.cast("long") - cursor.cast("long"), F.lit(TICKS))
    return (ahead > 0) & (ahead < TICKS // 2)


def next_tick(tick: Column) -> Column:
    return F.pmod(tick.cast("long") + 1, F.lit(TICKS))


def backoff_ms(attempt: Column, seed: Column, initial: int, most: int, jitter_percent: int) -> Column:
    """Delay before the next attempt: doubled from ``initial`` up to ``most``, moved by ``seed`` within the jitter; 0 for attempt 0.

    The jitter's half width is whole hundredths of the delay, so delays under 100 have none.
    """
    if initial == 0:
        return F.lit(0).cast("long")
    steps = 0
    while initial << steps < most:
        steps += 1
    delay = F.least(F.lit(most).cast("long"), F.lit(initial).cast("long") * F.pow(F.lit(2), F.least(attempt - 1, F.lit(steps))).cast("long"))
    span = F.floor(delay / 100).cast("long") * jitter_percent
    moved = F.when(span == 0, delay).otherwise(delay - span + F.pmod(seed.cast("long"), span * 2 + 1))
    return F.when(attempt <= 0, F.lit(0).cast("long")).otherwise(moved)


def should_retry(attempt: Column, kind: Column, code: Column, max_attempts: int, fatal: list[int]) -> Column:
    never = code.isin(*fatal) if fatal else F.lit(False)
    return (attempt < max_attempts) & (kind != "non_retryable") & ~never


def moving_mean(samples: Column) -> Column:
    """Integer mean of an ordered array in which each sample weighs an eighth; the first seeds it. Null for none."""
    return F.aggregate(F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), F.get(samples, F.lit(0)).cast("long"), lambda a, x: F.shiftright(a * 7 + x, 3))


def histogram_place(value: Column, boundaries: list[float]) -> Column:
    """Index of the first boundary that is not below the value; their number beyond the last."""
    place = F.lit(len(boundaries))
    for i in reversed(range(len(boundaries))):
        place = F.when(value <= boundaries[i], i).otherwise(place)
    return place


def chunk_geometry(length: int, workers: int, grain: int | None = None) -> list[tuple[int, int]]:
    """Half-open chunks of a range: eight for each worker unless ``grain`` is given."""
    if length < 0:
        raise ValueError("a range can't end before its start")
    if grain is not None and grain < 1:
        raise ValueError("a grain has at least one item")
    size = grain or max(1, -(-length // (workers * 8)))
    return [(a, min(a + size, length)) for a in range(0, length, size)]


def error_class(code: Column) -> Column:
    """Class of a stable error code; unknown ones are permanent."""
    out = F.lit("permanent")
    for c, name in ERROR_CLASS.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def checkpoint_due(last_snapshot: Column, sequence: Column, status: Column, interval: int = 64) -> Column:
    """Whether a state is to be saved: after ``interval`` events, when it waits or compensates, or when it has ended."""
    return (sequence - last_snapshot >= interval) | status.isin("waiting", "compensating", "completed", "failed", "cancelled", "terminated")
