"""SimHash near-duplicates: fingerprints of whole texts, pigeonring candidates, full Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize, slices
from .components import components

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, in the text's order, as ``simhash`` parts them; empty without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[-n:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text.

    A-Z are lower-cased, words are what ASCII white space parts, shingles are ``words`` words joined by a space (a shorter
    text is one shingle), repeats count. A bit is 1 if over half of the shingles' XXH64 have it. No words or null: 0.
    """
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The same of a text's shingle hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        some = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; ``fp`` is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([simhash(t, words, seed) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _ring(x: str, at: int, length: int) -> str:
    """SQL for ``length`` consecutive segments of ``x`` from segment ``at`` on, around the ring, as one number."""
    parts = [f"((shiftrightunsigned({x}, {WIDTH * ((at + k) % SEGMENTS)}) & {(1 << WIDTH) - 1}L) << {WIDTH * (length - 1 - k)})" for k in range(length)]
    return "(" + " | ".join(parts) + ")"


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different fingerprints (column ``fp``, distinct) that differ in 1 to ``radius`` bits.

    Pigeonring: four segments lie on a ring. If all differ in at most 3 bits, then from some segment on, each chain of l
    segments differs in at most floor(3 l / 4) bits: the first not at all, the first two in one bit, three in two, all in three.
    The chain of two is the join key: one side brings its own, the other its own and those with one more bit set
    in the second segment, so that a difference of one bit meets in one direction only. The chain of three prunes what
    is left before the full check. Keys have 32 bits, so buckets stay small and hold distinct fingerprints only.
    """
    if not 1 <= radius <= 3:
        raise ValueError("the chains are laid out for a radius of 1 to 3")
    own = ", ".join(f"named_struct('at', {s}, 'key', {_ring('fp', s, 2)})" for s in range(SEGMENTS))
    index = fps.selectExpr("fp as b", f"inline(array({own}))")
    more = ", ".join(
        f"named_struct('at', {s}, 'keys', concat(array({_ring('fp', s, 2)}), transform(filter(sequence(0, {WIDTH - 1}), i -> (shiftrightunsigned({_ring('fp', s, 2)}, i) & 1) = 0), i -> {_ring('fp', s, 2)} | shiftleft(1L, i))))"
        for s in range(SEGMENTS)
    )
    probe = fps.selectExpr("fp as a", f"inline(array({more}))").selectExpr("a", "at", "posexplode(keys) as (nth, key)")
    met = probe.join(index, ["at", "key"]).where("nth > 0 or a < b")
    three = " ".join(f"when {s} then {_ring('(a ^ b)', s, 3)}" for s in range(SEGMENTS))
    near = met.where(f"a <> b and bit_count(case at {three} end) <= {3 * radius // SEGMENTS} and bit_count(a ^ b) <= {radius}")
    return near.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``: component_id is the least doc_id linked directly or over others.

    Rows of one fingerprint are linked; they count as one node, so thousands of copies cost one row in the link search.
    Null texts and texts without words have fingerprint 0. A null doc_id keeps its row; it takes part only with others' ids.
    Repeated rows stay repeated. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    grouped = nodes.join(roots, F.col("fp") == F.col("node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    named = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = materialize(named, "simhash-groups")  # with nothing but exchanges below it, the join can split the rows of a hot fingerprint
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str) -> F.Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The documents whose doc_id names their group, all columns. Rows without a doc_id stay; rows that repeat a doc_id stay or go together."""
    kept = near_duplicates(docs, words=words, radius=radius).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
