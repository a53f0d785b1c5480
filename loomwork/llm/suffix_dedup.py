"""Exact substring de-duplication by blockwise suffix sorting of those suffixes only that can have a twin.

A window is a string of ``length`` bytes; a byte goes if a window over it also starts earlier. Windows are dealt to suffix
buckets by their minimizer, the 24-gram of least hash in them, which equal windows share. A run of windows with one
minimizer travels as one string. Buckets with a single occurrence are left out at once; the others are sorted one block
of buckets at a time. Long ties are resolved by ranks of a cover sample: suffixes are laid out so that their minimizers
are congruent modulo 16, which makes the places congruent to 0 a difference cover for all pairs that are compared; the
ranks of the 16, 32 and 64 bytes from those places are computed once per block, and a suffix is ordered by the bytes before its first sample
place, two sample ranks and the bytes after. Memory is bounded by the block and the largest bucket, see HOT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import discard, materialize, spread

GRAM, STEP = 24, 16
#: Bytes of text whose minimizers are computed together, and bytes of suffix strings sorted together.
CHUNK_BYTES, BLOCK_BYTES = 4 << 20, 2 << 20
#: A minimizer with more than HOT occurrences is no bucket: its windows go to buckets by what STRIDE windows side by side share,
#: and beyond HOTTER times as many by all their bytes. So a bucket holds at most HOT strings of up to 175 bytes, or HOT * HOTTER of up
#: to 107, or equal ones only, which need no memory; suffix sorting decides in all of them.
HOT, HOTTER, STRIDE = 50_000, 20, 8
#: Suffixes that are sorted at once; larger blocks are sorted by ranges of the minimizer's place in the window.
SORT_ROWS = 400_000
#: Strings of a task that are remembered, to send equal ones once.
SEEN = 300_000
#: Places are below this power of two in the combined key of hash and place.
PLACE = 28


def words64(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; the last seven places have none."""
    return np.ndarray((max(0, len(raw) - 7),), ">u8", raw, strides=(1,)) if len(raw) > 7 else np.zeros(0, ">u8")


def gram_hashes(raw: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the GRAM = 24 bytes from each place (or those in ``at``) on."""
    w = words64(raw)
    with np.errstate(over="ignore"):
        a, b, c = (w[: len(w) - 16], w[8 : len(w) - 8], w[16:]) if at is None else (w[at], w[at + 8], w[at + 16])
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) + c.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, windows, anchor, hash)`` of the runs of windows with one minimizer in one text (leftmost among equals)."""
    hashes = gram_hashes(raw)
    width, n = length - GRAM + 1, len(raw) - length + 1
    key = (hashes >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    low, size = key, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n], low[width - size : width - size + n])
    anchor = (low[:n] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return start, np.diff(np.append(start, n)), anchor[start], hashes[anchor[start]]


def pieces(raws: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of ``(text, offset, bytes)`` of about CHUNK_BYTES; long texts come in pieces that overlap by a window less one."""
    held, size = [], 0
    for i, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - length + 1), CHUNK_BYTES):
            piece = raw[at : at + CHUNK_BYTES + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def pack(start: np.ndarray, anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """One long: where the run starts, the anchor's distance from there, how many windows it has."""
    return (start << 20) | (anchor << 10) | windows


def _utf8(column: pa.Array) -> list[bytes]:
    return [(t or b"") for t in column.cast(pa.binary()).to_pylist()]


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """``(h, n, doc, at, more)``: per chunk of text a row for each minimizer, with its one occurrence or all of them in ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for held in pieces(_utf8(part.column(1)), length):
                    found = [(i, at, *runs(np.frombuffer(piece, np.uint8), length)) for i, at, piece in held]
                    h = (np.concatenate([f[5] for f in found]) >> np.uint64(16)).view(np.int64)  # 48 bits: a rare clash only costs work
                    doc = np.concatenate([np.full(len(f[2]), ids[f[0]]) for f in found])
                    packed = np.concatenate([pack(f[2] + f[1], f[4] - f[2], f[3]) for f in found])
                    order = np.argsort(h, kind="stable")
                    h, doc, packed = h[order], doc[order], packed[order]
                    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    n = np.diff(np.append(first, len(h)))
                    many = n > 1
                    flat = np.repeat(many, n)
                    ends = np.concatenate([[0], np.cumsum(np.where(many, n, 0))]).astype(np.int32)
                    offsets = pa.array(ends, pa.int32(), mask=np.append(~many, False))
                    more = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(doc[flat]), pa.array(packed[flat])], ["doc", "at"]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(n.astype(np.int32)), pa.array(doc[first], mask=many), pa.array(packed[first], mask=many), more], ["h", "n", "doc", "at", "more"])

    return docs.mapInArrow(run, "h long, n int, doc long, at long, more array<struct<doc:long,at:long>>")


def parts_of_run(raw: bytes, at: int, level: int, length: int) -> Iterator[tuple[int, int, int]]:
    """``(key, start, windows)`` of the parts in which a hot run travels.

    Windows are parted by their minimizer's place in them, so that equal windows are in like parts whatever surrounds them, and
    the key is the hash of the bytes that all windows of a part have, or would have if the run were longer.
    """
    start, anchor, windows = at >> 20, (at >> 20) + ((at >> 10) & 1023), at & 1023
    stride = 1 if level == 2 else STRIDE
    low = start
    while low < start + windows:
        part = (anchor - low) // stride
        last = anchor - part * stride  # the last window whose minimizer has such a place
        n = min(last + 1, start + windows) - low
        yield xxhash.xxh3_64_intdigest(raw[last : last - stride + 1 + length], part) - (1 << 63), low, n
        low += n


def suffixes(joined: DataFrame, length: int) -> DataFrame:
    """``(key, doc, at, payload)`` of the runs in ``twins``: the string of a run, or of each part of a hot one; null if known.

    Documents of a task come in order, so of equal strings in a task only the earliest travels; the others are known to
    go, whatever else there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last = None
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids, raws, lists = part.column(0).to_pylist(), _utf8(part.column(1)), part.column(2).to_pylist()
                out: tuple[list, list, list, list] = ([], [], [], [])

                def put(key: int, doc: int, at: int, payload: bytes) -> None:
                    known = payload in seen
                    if not known:
                        seen.add(payload)
                    if known and out[3] and out[3][-1] is None and out[1][-1] == doc:
                        start, windows = out[2][-1] >> 20, out[2][-1] & 1023
                        if at >> 20 == start + windows and windows + (at & 1023) < 1024:  # known runs side by side are one
                            out[2][-1] += at & 1023
                            return
                    for column, value in zip(out, (((doc * 0x9E3779B1 + at) & ((1 << 63) - 1)) if known else key, doc, at, None if known else payload), strict=True):
                        column.append(value)

                for i in sorted(range(len(ids)), key=ids.__getitem__):
                    raw, doc = raws[i], ids[i]
                    if len(seen) > SEEN or last is not None and doc < last:
                        seen.clear()
                    last = doc
                    places = [(x >> 2, x & 3) for x in sorted(lists[i])]
                    packed = np.array([p for p, _ in places], np.int64)
                    keys = gram_hashes(np.frombuffer(raw, np.uint8), (packed >> 20) + ((packed >> 10) & 1023)).view(np.int64).tolist()
                    for (at, level), key in zip(places, keys, strict=True):
                        start, windows = at >> 20, at & 1023
                        if not level:
                            put(key, doc, at, raw[start : start + windows + length - 1])
                            continue
                        for own, begin, n in parts_of_run(raw, at, level, length):
                            put(own, doc, (begin << 20) | ((start + ((at >> 10) & 1023) - begin) << 10) | n, raw[begin : begin + n + length - 1])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["key", "doc", "at", "payload"])

    return joined.mapInArrow(run, "key long, doc long, at long, payload binary")


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Rank of each pair among all, equal pairs alike."""
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
    ranks = np.empty(len(order), np.int64)
    ranks[order] = new
    return ranks


def twins_in_block(bucket: np.ndarray, anchor: np.ndarray, windows: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """Which windows, run by run in order, equal an earlier one of their bucket: suffix sort of the block.

    Runs come bucket by bucket, earliest first. The sort is stable, so in a class of equal suffixes the first is the earliest.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    lead = (-anchor) % STEP  # filling before each string: its anchor comes to a multiple of STEP
    span = -(-(lead + size + 2 * STEP) // STEP) * STEP
    base = np.concatenate([[0], np.cumsum(span)])
    text = np.zeros(int(base[-1]) + 8 * STEP, np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    begin = base[:-1] + lead
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    text[np.repeat(begin - offset, size) + np.arange(len(flat))] = flat
    sample = text[: len(text) // STEP * STEP].view(">u8").reshape(-1, 2).astype(np.uint64)
    r16 = _ranks(sample[:, 0], sample[:, 1])
    pad = lambda r, k: np.concatenate([r[k:], np.zeros(k, np.int64)])
    r32 = _ranks(r16, pad(r16, 1))
    r64 = _ranks(r32, pad(r32, 2))

    w = words64(text)
    mask = lambda n: np.where(n >= 8, ~np.uint64(0), ~(~np.uint64(0) >> (8 * np.minimum(n, 7)).astype(np.uint64)))  # noqa: E731  the first n bytes
    part = lambda at, n: (w[at].astype(np.uint64) & mask(n), np.where(n > 8, w[at + 8].astype(np.uint64) & mask(np.maximum(n - 8, 0)), 0))
    all_rows = np.repeat(np.arange(len(strings), dtype=np.int32), windows)
    all_nth = (np.arange(len(all_rows)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)).astype(np.int32)
    twin = np.zeros(len(all_rows), bool)
    step = max(1, length * SORT_ROWS // max(1, len(all_rows)))
    inside = anchor[all_rows] - all_nth  # the minimizer's place in each window: equal windows agree in it
    for low in range(0, length, step):
        some = np.flatnonzero((inside >= low) & (inside < low + step)) if step < length else np.arange(len(all_rows))
        if len(some) < 2:
            continue
        row, place = all_rows[some], begin[all_rows[some]] + all_nth[some]
        head = (-place) % STEP
        first = (place + head) // STEP
        blocks = (length - head) // STEP  # whole sample blocks in the window
        extra = np.where(blocks == 4, 0, np.where(blocks == 5, r16[first + 4], r32[first + 4]))
        (h1, h2), (t1, t2) = part(place, head), part((first + blocks) * STEP, length - head - blocks * STEP)
        keys = (t2, t1, extra, r64[first], h2, h1, bucket[row] * 1024 + inside[some])
        order = np.lexsort(keys)
        same = np.ones(len(order) - 1, bool)
        for key in keys:
            k = key[order]
            same &= k[1:] == k[:-1]
        twin[some[order[1:][same]]] = True
        if step >= length:
            break
    return twin


def spans(strings: DataFrame, length: int) -> DataFrame:
    """``(doc, low, high)`` of stretches to remove, from ``suffixes`` dealt by key and sorted by key, payload, doc and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []  # bucket, doc, at, string: runs of buckets in the block
        held, bucket, last_key, last_payload = 0, 0, None, None
        out: tuple[list[int], list[int], list[int]] = ([], [], [])

        def whole(doc: int, at: int) -> None:
            out[0].append(doc)
            out[1].append(at >> 20)
            out[2].append((at >> 20) + (at & 1023) + length - 1)

        def sort() -> None:
            nonlocal held
            counts = np.bincount([r[0] for r in rows], minlength=1) if rows else []
            some = sorted(r[:3] + (r[3],) for r in rows if counts[r[0]] > 1)
            rows.clear()
            held = 0
            if not some:
                return
            at = np.array([r[2] for r in some], np.int64)
            windows = at & 1023
            twin = twins_in_block(np.array([r[0] for r in some], np.int64), (at >> 10) & 1023, windows, [r[3] for r in some], length)
            row = np.repeat(np.arange(len(some)), windows)
            place = (at >> 20)[row] + np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
            begins = np.flatnonzero(twin & ~np.concatenate([[False], twin[:-1] & (row[1:] == row[:-1])]))
            ends = np.flatnonzero(twin & ~np.concatenate([twin[1:] & (row[1:] == row[:-1]), [False]]))
            out[0].extend(some[i][1] for i in row[begins].tolist())
            out[1].extend(place[begins].tolist())
            out[2].extend((place[ends] + length).tolist())

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc", "low", "high"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for key, doc, at, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if payload is None:
                    whole(doc, at)
                    continue
                if key == last_key and payload == last_payload:
                    whole(doc, at)  # an earlier run has the same string
                    continue
                if key != last_key:
                    bucket += 1
                    if held >= BLOCK_BYTES:
                        sort()
                        bucket = 1
                last_key, last_payload = key, payload
                if len(payload) >= length:
                    rows.append((bucket, doc, at, payload))
                    held += len(payload)
            if out[0]:
                yield flush()
        sort()
        if out[0]:
            yield flush()

    dealt = strings.repartition(spread(strings.sparkSession), "key").sortWithinPartitions("key", "payload", "doc", "at")
    return dealt.mapInArrow(run, "doc long, low long, high long")


def merged(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    """The union of stretches as maximal runs."""
    found: list[list[int]] = []
    for a, b in sorted(zip(low, high, strict=True)):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a long column that orders documents and that no two rows share.

    It is the id itself unless ids repeat or are null: then rows are numbered by id (null first) and text, in a new column.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    if not ids.groupBy("i").agg(F.count("*").alias("n")).where("n > 1 or i is null").limit(1).take(1):
        return docs, id_col
    name = "row"
    while name in docs.columns:
        name += "_"
    order = (F.col(id_col).cast("long").asc_nulls_first(), F.xxhash64(F.col(text_col).cast("string")))
    ranged = docs.repartitionByRange(spread(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def removed_spans(rows: DataFrame, length: int = 100) -> DataFrame:
    """``(doc, text, spans)``, and ``rest`` if there, per row of ``(doc, text[, rest])`` with distinct ``doc``: ``spans`` are the byte runs to remove, null if none."""
    if not 95 <= length <= 111:
        raise ValueError("window lengths of 95 to 111 bytes are laid out")
    parts = spread(rows.sparkSession)
    # both joins by doc read one exchange of the texts: the filter makes their plans equal, and lists come as plain longs
    carried = [c for c in rows.columns if c == "rest"]
    texts = rows.where("doc is not null").select("doc", "text", *carried).repartition(parts, "doc")
    found = materialize(occurrences(rows.select("doc", "text"), length), "minimizers")
    # counts are combined before the shuffle, so a minimizer of many documents is a row per task, and the join splits its rows
    totals = found.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1")
    twins = found.join(totals.hint("shuffle_merge"), "h").selectExpr(f"case when total > {HOT * HOTTER} then 2 when total > {HOT} then 1 else 0 end as level", "inline(coalesce(more, array(named_struct('doc', doc, 'at', at))))")
    lists = materialize(twins.groupBy("doc").agg(F.collect_list(F.expr("(at << 2) | level")).alias("runs")), "twin-runs")
    discard(found)
    strings = suffixes(texts.join(lists.hint("shuffle_merge"), "doc").select("doc", "text", "runs", *carried), length)
    gone = spans(strings, length).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return texts.join(gone.hint("shuffle_merge"), "doc", "left")


def deduplicate(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kept, n_bytes, n_removed, n_spans)``: ``kept`` are the bytes that stay.

    Every byte under a string of ``length`` bytes that also starts earlier (smaller id, or earlier in the document) goes.
    Null texts are empty. Rows that repeat an id, and rows without one, are documents of their own, in the order of
    ``with_key``. Empty table: no rows. Matches never cross documents; a removal may part a multi-byte character.
    """
    rows, key = with_key(docs, id_col, text_col)
    result = removed_spans(rows.select(F.col(key).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for raw, spans_ in zip(_utf8(part.column(1)), part.column(2).to_pylist(), strict=True):
                    cuts = merged([s["low"] for s in spans_ or ()], [s["high"] for s in spans_ or ()])
                    edges = [0, *(x for c in cuts for x in c), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    for column, value in zip(out, (kept, len(raw), len(raw) - len(kept), len(cuts)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc", "kept", "n_bytes", "n_removed", "n_spans"])

    done = result.mapInArrow(run, "doc long, kept binary, n_bytes long, n_removed long, n_spans long")
    if key == id_col:
        done = done.withColumn("doc_id", F.col("doc"))
    else:
        done = done.join(rows.select(F.col(key).alias("doc"), F.col(id_col).cast("long").alias("doc_id")), "doc")
    return done.select("doc_id", "kept", "n_bytes", "n_removed", "n_spans")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with all its columns: ``text`` less the removed bytes (a character that loses a byte goes whole), ``n_chars`` as it then is.

    Rows that repeat a doc_id, or have none, are documents of their own, as in ``deduplicate``. Null texts stay null.
    """
    rows, key = with_key(docs, "doc_id", "text")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    # all other columns travel beside the text, so that nothing has to be joined again
    kept = removed_spans(rows.select(F.col(key).cast("long").alias("doc"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("rest")), length)
    kept = kept.select("text", "spans", "rest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = []
                for text, raw, spans_ in zip(part.column(0).to_pylist(), _utf8(part.column(0)), part.column(1).to_pylist(), strict=True):
                    if spans_:
                        edges = [0, *(x for c in merged([s["low"] for s in spans_], [s["high"] for s in spans_]) for x in c), len(raw)]
                        text = "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2], strict=True))
                    texts.append(text)
                changed = pa.array([bool(x) for x in part.column(1).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), changed, part.column(2)], ["text", "changed", "rest"])

    schema = StructType([StructField("text", StringType()), StructField("changed", BooleanType()), kept.schema["rest"]])
    done = kept.mapInArrow(cut, schema)
    columns = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*(columns[c].cast(docs.schema[c].dataType).alias(c) if c in columns else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def brute_force(texts: list[bytes], length: int = 100) -> list[list[bool]]:
    """Per document, in order, which bytes go: the plain definition, for tests."""
    seen: set[bytes] = set()
    found = []
    for raw in texts:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        found.append(gone)
    return found
