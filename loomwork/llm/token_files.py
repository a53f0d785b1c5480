"""Token-id shards: raw ids in ascending key order, and a minimal perfect hash index per shard for constant-time keyed access.

A shard is two files. ``shard-N-attempt.ids`` holds the ids of its documents one after the other, in ascending key order, as
little-endian unsigned integers of 2 bytes, or of 4 where the vocabulary needs them. ``shard-N-attempt.idx`` is a numpy archive:

* ``keys`` int64, the distinct keys in order; ``first`` int64, the row at which each begins; ``nulls``, how many rows with a null key come first
* ``ends`` int64, per row the number of ids up to its end
* ``levels`` int64 and ``bits`` uint64: the perfect hash. At each level the keys left are hashed to twice as many places;
  those alone in theirs get its bit, the others go on. A key's slot is the number of bits before its own.
* ``slot_row`` int64, ``slot_print`` uint32: per slot the position in ``keys`` and a fingerprint of the key, which refuses most foreign keys
"""

from __future__ import annotations

import bisect
import io
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize, open_store, sized_slices, spread, work_dir

#: Remembered pieces per worker, and the longest that is remembered; both bound memory only.
REMEMBERED, LONGEST = 900_000, 48
#: Bytes of payload that a reader holds at once, unless one document is longer.
READ_BYTES = 16 << 20
#: Bytes of text that are encoded together, unless one text is longer.
SLICE_BYTES = 16 << 20


class ByteEncoder:
    """Ids of whole texts by the ``tokenizers`` library and a byte-level file.

    The file's pattern always ends a piece before a blank that stands between two characters that aren't white space. So
    texts are parted at blanks, each distinct piece goes to the library once, and the ids of all texts are gathered from
    those of their pieces. Texts with other white space around a blank go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.leads = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.leads[[i for token, i in self.library.get_vocab().items() if token[0] == "\u0120"]] = True  # the byte-level form of a blank
        self.known: dict[str, bytes] = {}  # by piece without the blank before it

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, f"<u{self.width}").tobytes() for at in range(0, len(texts), 4096) for found in self.library.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of clean pieces, each with the blank before it: encoded as one text, whose only tokens with a blank at their start begin the pieces."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 1024):
            some = pieces[at : at + 1024]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            edges = (np.append(np.flatnonzero(self.leads[ids]), len(ids)) * self.width).tolist()
            raw = ids.tobytes()
            out += map(raw.__getitem__, map(slice, edges, edges[1:])) if len(edges) == len(some) + 1 else self._library([" " + p for p in some])
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces with the blank before them; None where white space stands at an end."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        found = list(map(known.get, pieces))
        new, at = [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            p = pieces[i]
            if p and not p[0].isspace() and not p[-1].isspace():
                new.append(p)
                at.append(i)
        for i, p, x in zip(at, new, self._words(new), strict=True):
            found[i] = x
            if len(p) <= LONGEST:
                known[p] = x
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Null texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(texts, " ")
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)  # one at least
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        first = np.cumsum(n) - n
        later = np.ones(len(at), bool)
        later[first] = False  # a text's first piece has no blank before it and goes to the library as it is
        needed = np.zeros(len(words), bool)
        needed[at[later]] = True
        if needed.all():
            ids = self._pieces(words)
        else:
            ids = [b""] * len(words)
            for i, x in zip(np.flatnonzero(needed).tolist(), self._pieces([w for w, x in zip(words, needed.tolist(), strict=True) if x]), strict=True):
                ids[i] = x
        heads = [words[i] for i in at[first].tolist()]
        whole = np.fromiter((bool(h) and h[-1].isspace() for h in heads), bool, len(heads)) & (n > 1)
        if None in ids:
            unclean = np.fromiter((x is None for x in ids), bool, len(ids))
            whole[np.repeat(np.arange(len(texts)), n)[later & unclean[at]]] = True
        own = whole.tolist()
        out = self._library([texts[i].as_py() if w else h for i, (h, w) in enumerate(zip(heads, own, strict=True))])
        places = at.tolist()
        for i, (a, k) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
            if k > 1 and not own[i]:
                out[i] += b"".join([ids[x] for x in places[a + 1 : a + k]])
        return out


_loaded: dict[str, ByteEncoder] = {}


def loaded(path: str) -> ByteEncoder:
    if path not in _loaded:
        _loaded[path] = ByteEncoder(path)
    return _loaded[path]


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of int64 keys: multiply and shift, twice."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


PRINT_SEED = 1 << 20


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys; see the module's text for the layout."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray) -> None:
        self.levels, self.bits = levels, bits
        self.starts = np.concatenate([[0], np.cumsum(levels)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @staticmethod
    def of(keys: np.ndarray) -> PerfectHash:
        left, levels, parts = keys.astype(np.int64), [], []
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            place = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            levels.append(size)
            left = left[~alone[place]]
        return PerfectHash(np.array(levels, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot per key, -1 for some foreign keys; other foreign keys get any slot."""
        keys = np.asarray(keys, np.int64)
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.levels.tolist()):
            if not len(open_):
                break
            bit = self.starts[level] + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, at = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.bits[word] >> at) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << at) - np.uint64(1))
            found[open_[here]] = (self.before[word] + np.bitwise_count(below).astype(np.int64))[here]
            open_ = open_[~here]
        return found


def index_bytes(keys: np.ndarray, nulls: int, ends: np.ndarray, width: int) -> bytes:
    """The archive for rows in order: ``keys`` of those that have one, after ``nulls`` rows without."""
    distinct, first = np.unique(keys, return_index=True)
    perfect = PerfectHash.of(distinct)
    slots = perfect.slots(distinct)
    row, prints = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.uint32)
    row[slots] = np.arange(len(distinct))
    prints[slots] = (mix(distinct, PRINT_SEED) >> np.uint64(32)).astype(np.uint32)
    np.savez(out := io.BytesIO(), keys=distinct, first=first + nulls, nulls=nulls, ends=ends, width=width, levels=perfect.levels, bits=perfect.bits, slot_row=row, slot_print=prints)
    return out.getvalue()


class Shard:
    """One shard opened for reading."""

    def __init__(self, folder: str, name: str) -> None:
        self.store, path = open_store(folder)
        self.path = f"{path}/{name}"
        with self.store.open_input_stream(f"{self.path}.idx") as f:
            found = np.load(io.BytesIO(f.read()))
            self.keys, self.first, self.ends, self.row, self.prints = (found[k] for k in ("keys", "first", "ends", "slot_row", "slot_print"))
            self.width, self.nulls = int(found["width"]), int(found["nulls"])
            self.perfect = PerfectHash(found["levels"], found["bits"])

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 for keys that aren't in the shard: slot, fingerprint, then the stored key itself."""
        keys = np.asarray(keys, np.int64)
        slots = self.perfect.slots(keys)
        at = np.maximum(slots, 0)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        ok = (slots >= 0) & (self.prints[at] == (mix(keys, PRINT_SEED) >> np.uint64(32)).astype(np.uint32))
        ok &= self.keys[self.row[at]] == keys
        return np.where(ok, self.first[self.row[at]], -1)

    def read(self, key: int) -> np.ndarray | None:
        """The ids of a key's first row, by one read of just their bytes; None if the key is foreign."""
        row = int(self.rows(np.array([key]))[0])
        if row < 0:
            return None
        start = int(self.ends[row - 1]) if row else 0
        with self.store.open_input_file(f"{self.path}.ids") as f:
            return np.frombuffer(f.read_at((int(self.ends[row]) - start) * self.width, start * self.width), f"<u{self.width}")


class Tokens:
    """All shards of a manifest: a key's range leads to the one shard that can hold it."""

    def __init__(self, manifest: DataFrame, folder: str) -> None:
        self.folder, self.open = folder, {}
        self.rows = manifest.where("least is not null").select("name", "least", "most").orderBy("shard").collect()  # a row per shard
        self.most = [r["most"] for r in self.rows]

    def read(self, key: int) -> np.ndarray | None:
        """The ids of a key's first row; None if no shard has it. Opens the index of one shard, and reads the key's bytes only."""
        at = bisect.bisect_left(self.most, key)
        if at == len(self.rows) or key < self.rows[at]["least"]:
            return None
        if at not in self.open:
            self.open[at] = Shard(self.folder, self.rows[at]["name"])
        return self.open[at].read(key)


MANIFEST = "shard int, name string, least long, most long, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id`` to each document and write shards to ``folder``; returns the manifest, a row per shard.

    Shards are ranges of keys in ascending order, null keys first. Null and empty texts are the end id alone. Rows that
    repeat a key, or have none, stay, in the order of their texts' hashes, by which a range of them is parted too; the index
    leads to the first. Empty table: empty manifest. A shard's files have a name of the attempt's own, which the manifest
    tells together with the least and greatest key, so a task can run again and a reader never mixes attempts.
    """
    order = ("doc_id", F.xxhash64("text"))
    ranged = id_and_text(docs, id_col, text_col).repartitionByRange(spread(docs.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, context = loaded(path), TaskContext.get()
        number = context.partitionId()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"shard-{number:06d}-{context.taskAttemptId()}"
        keys, ends, total, nulls, out = [], [], 0, 0, None
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        for part in sized_slices(batches, 4096, SLICE_BYTES):
            out = out or store.open_output_stream(f"{base}/{name}.ids")
            own = part.column(0)
            nulls += own.null_count
            keys.append(own.drop_null().to_numpy(zero_copy_only=False))
            found = encoder.encode(part.column(1))
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // encoder.width + 1
            ends.append(total + np.cumsum(sizes))
            total = int(ends[-1][-1])
            out.write(end.join([*found, b""]))
        if out:
            out.close()
            own = np.concatenate(keys)
            with store.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(index_bytes(own, nulls, np.concatenate(ends), encoder.width))
            edges = (int(own[0]), int(own[-1])) if len(own) else (None, None)
            row = (number, name, *edges, sum(map(len, ends)), total)
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split(" ")[0] for x in MANIFEST.split(", ")])

    return materialize(ranged.mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per row from the files: each key is looked up in its shard's index and its ids are read."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "name", before.alias("base")).repartition(spread(manifest.sparkSession), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = Shard(folder, name)
                starts = np.concatenate([[0], shard.ends[:-1]])
                own = np.full(len(shard.ends), -1, np.int64)
                own[shard.rows(shard.keys)] = np.arange(len(shard.keys))
                own = np.maximum.accumulate(own)  # rows that repeat a key follow its first
                with shard.store.open_input_file(f"{shard.path}.ids") as f:
                    at = 0
                    while at < len(own):
                        to = max(at + 1, int(np.searchsorted(shard.ends, starts[at] + READ_BYTES // shard.width, "right")))
                        raw = np.frombuffer(f.read_at(int(shard.ends[to - 1] - starts[at]) * shard.width, int(starts[at]) * shard.width), f"<u{shard.width}").astype("<u4")
                        view, low, high = memoryview(raw).cast("B"), ((starts[at:to] - starts[at]) * 4).tolist(), ((shard.ends[at:to] - starts[at]) * 4).tolist()
                        crc = [zlib.crc32(view[a:b]) for a, b in zip(low, high, strict=True)]
                        keys = shard.keys[np.maximum(own[at:to], 0)] if len(shard.keys) else np.zeros(to - at, np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, mask=own[at:to] < 0), pa.array(starts[at:to] + base), pa.array(shard.ends[at:to] - starts[at:to]), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    folder = work_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, folder, end_id), folder)
