"""The modified Kneser-Ney trigram model over all words of trusted text, as counts that documents are joined with in shards.

A word is its 64-bit hash, an n-gram a 64-bit mix of its words'; no vocabulary is gathered anywhere. Training leaves three
tables of counts, dealt to shards by the hash of their key:

* trigrams: how often each occurs
* bigrams: by how many words each is preceded; as a context how often, and how many words follow it once, twice, more often
* words: the same, counted over bigrams

Documents ask for the counts of their distinct words, bigrams and trigrams, so a frequent key is one row of a pack of
documents, not one per occurrence. A shard answers with the counts, and the pack turns them into probabilities with its
model's discounts. Words that trusted text lacks share what the words' discounts leave: they are one unknown token.

What travels is compressed: a shard's keys keep 40 bits beside the shard's number and go sorted, as differences. A shard's
size is bounded, as their number grows with the trusted text, so a foreign key is taken for a seen one about once in a million.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, open_store, remove, slices, spread, work_dir

START, END = 0, 1
#: Bytes of text that are packed together; documents are looked up in so many blocks, one after the other, so that only a block's requests lie on disk.
PACK_BYTES, BLOCKS = 8 << 20, 4
#: Trusted text of one shard, at most about, and the least number of shards: it follows the text, not the cluster, as every pack has a row in every shard.
SHARD_BYTES, LEAST_SHARDS = 8 << 20, 24
KEY_BITS = 40
WORDS, BIGRAMS, TRIGRAMS = 1, 2, 3
#: Counts of a key: of itself, then as a context its total and how many words follow once, twice, more often.
COLUMNS = {WORDS: 5, BIGRAMS: 5, TRIGRAMS: 1}


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on as byte planes, compressed; a column's planes of zeros at the top are left out."""
    head, parts = [len(columns)], []
    for x in columns:
        width = -(-int(x.max()).bit_length() // 8) if len(x) else 0
        head += [len(x), width]
        parts.append(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes())
    raw = np.array(head, "<u8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(packed: bytes) -> list[np.ndarray]:
    """The columns as unsigned 64-bit numbers."""
    raw = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, "<u8", 2 * n, 8).reshape(-1, 2).tolist()
    found, at = [], 8 + 16 * n
    for size, width in head:
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        found.append(x.view("<u8").ravel())
        at += size * width
    return found


def _sorted(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences."""
    return np.diff(keys, prepend=np.uint64(0))


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One 64-bit key of two."""
    with np.errstate(over="ignore"):
        z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ np.uint64(0xD1B54A32D192ED03))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(KEY_BITS)) % np.uint64(shards)


def dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of keys by shard and the bits kept there, those bits in that order, and where each shard begins."""
    bits = keys & np.uint64((1 << KEY_BITS) - 1)
    own = (shard_of(keys, shards) << np.uint64(KEY_BITS)) | bits
    order = np.argsort(own)
    edges = np.searchsorted(own[order], np.arange(shards + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
    return order, bits[order], edges


def parted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' hashes with START and END first, each text's words between two starts and an end as places among them, and numbers of words.

    White space parts words. Null texts have none.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    row = pc.list_parent_indices(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    raw, at = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if b"" in raw:
        real = at != raw.index(b"")
        row, at = row[real], at[real]
    # frequent words get low numbers, whose upper bytes are zeros
    order = np.argsort(-np.bincount(at, minlength=len(raw)), kind="stable")
    place = np.empty(len(raw), np.int64)
    place[order] = np.arange(2, len(raw) + 2)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    size = np.bincount(row, minlength=len(texts)).astype(np.int64)
    ends = np.cumsum(size + 3)
    stream = np.full(int(ends[-1]) if len(ends) else 0, START, np.int64)
    stream[ends - 1] = END
    stream[np.arange(len(at)) + 3 * row + 2] = place[at]
    return np.concatenate([np.array([START, END], np.uint64), hashes[order]]), stream, size


class Grams:
    """The distinct bigrams and trigrams of a pack and where each trigram stands."""

    def __init__(self, words: np.ndarray, stream: np.ndarray, size: np.ndarray) -> None:
        n = len(words)
        inner = np.ones(len(stream), bool)
        inner[np.cumsum(size + 3) - 1] = False
        pair = np.flatnonzero(inner)  # a bigram begins everywhere but at a text's last place
        self.two, at = np.unique(stream[pair] * n + stream[pair + 1], return_inverse=True)
        inner = np.ones(len(pair), bool)
        inner[np.cumsum(size + 2) - 1] = False
        first = np.flatnonzero(inner)  # a trigram's first bigram; its second is the next one
        code, some, self.at, self.n = np.unique(at[first] * n + stream[pair[first] + 2], return_index=True, return_inverse=True, return_counts=True)
        self.ab, self.bc, self.c = at[first][some], at[first + 1][some], code % n
        self.begins = np.concatenate([[0], np.cumsum(size + 1)[:-1]])  # of each text's trigrams
        self.b = self.two // n
        self.keys = {WORDS: words, BIGRAMS: mix(words[self.b], words[self.two % n])}
        self.keys[TRIGRAMS] = mix(self.keys[BIGRAMS][self.ab], words[self.c])


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], [k for k, _ in schema])


def _packs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, str, list[pa.RecordBatch]]]:
    """``(number, model_lang, rows)``: rows of one model with about ``most`` bytes of text; numbers are unique among a job's committed tasks."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def done(lang: str) -> tuple[int, str, list[pa.RecordBatch]]:
        nonlocal number
        number += 1
        size.pop(lang)
        return number, lang, held.pop(lang)

    for part in slices(batches):
        models = part.column("model_lang")
        for lang in pc.unique(models).to_pylist():
            own = part.filter(pc.equal(models, lang))
            held.setdefault(lang, []).append(own)
            size[lang] = size.get(lang, 0) + own.column("text").nbytes
            if size[lang] >= most:
                yield done(lang)
        if sum(size.values()) >= 4 * most:
            yield done(max(size, key=size.get))
    for lang in list(held):
        yield done(lang)


def _column(rows: list[pa.RecordBatch], name: str) -> pa.Array:
    return pa.concat_arrays([r.column(name) for r in rows])


#: Trusted trigrams of a pack in a shard: words, then places among them and counts. Also counts of a shard's keys, and of requests and answers.
PART = "shard int, lang string, pack long, data binary"
PART_TYPES = [("shard", pa.int32()), ("lang", pa.string()), ("pack", pa.int64()), ("data", pa.binary())]


def _of_shards(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of each shard or pack together; they come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        own = batch.column(by).to_numpy()
        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else [0]
        for a, b in zip(edges, edges[1:]):
            if held and own[a] != last:
                yield last, held
                held = []
            last = int(own[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def _trusted_grams(texts: DataFrame, shards: int) -> DataFrame:
    """A pack's distinct trigrams with counts, by the shard of the last two words: whatever precedes a bigram meets there."""
    most = PACK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, lang, rows in _packs(batches, most):
            words, stream, size = parted(_column(rows, "text"))
            grams = Grams(words, stream, size)
            shard = shard_of(grams.keys[BIGRAMS], shards)[grams.bc].astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges, n, out = np.searchsorted(shard[order], np.arange(shards + 1)), len(words), []
            for s in range(shards):
                some = order[edges[s] : edges[s + 1]]
                if len(some):
                    abc = np.stack([grams.two[grams.ab[some]] // n, grams.b[grams.bc[some]], grams.c[some]])
                    own, at = np.unique(words[abc.ravel()], return_inverse=True)
                    a, b, c = at.reshape(3, -1)
                    by = np.lexsort((a, c, b))
                    out.append((s, lang, number, squeeze(_sorted(own), a[by], b[by], c[by], grams.n[some][by])))
            yield _batch(out, PART_TYPES)

    return texts.mapInArrow(run, PART)


def _together(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    columns = [np.concatenate(c) for c in zip(*counts, strict=True)]
    return found, [np.bincount(at, c, len(found)).astype(np.int64) for c in columns]


def _followed(context: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Counts per row for a context: nothing of its own, its total, and whether what follows does once, twice or more often."""
    return [np.zeros(len(n), np.int64), n, n == 1, n == 2, n > 2]


def _counts(part: DataFrame, shards: int) -> DataFrame:
    """Counts of each shard's trigrams, dealt to the shards of their own keys; those of contexts are parts of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _of_shards(batches, "shard"):
            langs = _column(rows, "lang").to_pylist()
            packed = _column(rows, "data")
            for lang in dict.fromkeys(langs):
                parts = []
                for i, x in enumerate(langs):
                    if x == lang:
                        own, a, b, c, n = expand(packed[i].as_py())
                        own = _summed(own)
                        parts.append((own[a], own[b], own[c], n))
                a, b, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                ab = mix(a, b)
                abc, first, at = np.unique(mix(ab, c), return_index=True, return_inverse=True)
                n = np.bincount(at, n, len(abc)).astype(np.int64)
                ab, b, c = ab[first], b[first], c[first]
                bc, first, before = np.unique(mix(b, c), return_index=True, return_counts=True)
                b, c = b[first], c[first]
                zero, one = np.zeros(len(bc), np.int64), np.ones(len(bc), np.int64)
                tables = {
                    WORDS: _together([c, b], [[one, zero, zero, zero, zero], _followed(b, before)]),
                    BIGRAMS: _together([bc, ab], [[before, zero, zero, zero, zero], _followed(ab, n)]),
                    TRIGRAMS: (abc, [n]),
                }
                order = {kind: dealt(keys, shards) for kind, (keys, _) in tables.items()}
                out = []
                for s in range(shards):
                    parts = []
                    for kind, (_, columns) in tables.items():
                        at, bits, edges = order[kind]
                        some = slice(edges[s], edges[s + 1])
                        parts += [_sorted(bits[some]), *(x[at[some]] for x in columns)]
                    out.append((s, lang, 0, squeeze(*parts)))
                yield _batch(out, PART_TYPES)

    return part.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, PART)


LAW = "shard int, path string, lang string, kind int, types long, total long, n1 long, n2 long, n3 long, n4 long"
LAW_TYPES = [(k, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for k, t in (x.split(" ") for x in LAW.split(", "))]


def _write_shards(counts: DataFrame, shards: int, folder: str) -> DataFrame:
    """Add up each shard's counts and write them to a file of the attempt's own; a row per shard, model and kind with what its discounts need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        for shard, rows in _of_shards(batches, "shard"):
            parts: dict[tuple[str, int], list] = {}
            packed = _column(rows, "data")
            for i, lang in enumerate(_column(rows, "lang").to_pylist()):
                columns = expand(packed[i].as_py())
                for kind, n in COLUMNS.items():
                    keys, *own = columns[: n + 1]
                    del columns[: n + 1]
                    parts.setdefault((lang, kind), []).append((_summed(keys), own))
            name, out, arrays = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}", [], {}
            for i, ((lang, kind), own) in enumerate(sorted(parts.items())):
                keys, columns = _together(*zip(*own, strict=True))
                arrays[f"{i}"] = np.frombuffer(squeeze(_sorted(keys), *columns), np.uint8)
                n = columns[0][columns[0] > 0]
                out.append((shard, name, lang, kind, len(n), int(n.sum()), *(int((n == k).sum()) for k in (1, 2, 3, 4))))
            np.savez(raw := io.BytesIO(), names=np.array([f"{kind} {lang}" for _, _, lang, kind, *_ in out]), **arrays)
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(raw.getvalue())
            yield _batch(out, LAW_TYPES)

    return materialize(counts.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, LAW), "count-shards")


class Shard:
    """A shard's counts, opened for look-ups."""

    def __init__(self, folder: str, name: str | None) -> None:
        self.tables: dict[tuple[str, int], tuple[np.ndarray, list[np.ndarray]]] = {}
        if name is None:
            return
        store, base = open_store(folder)
        with store.open_input_stream(f"{base}/{name}") as f:
            held = np.load(io.BytesIO(f.read()))
            for i, own in enumerate(held["names"].tolist()):
                kind, _, lang = own.partition(" ")
                keys, *columns = expand(held[f"{i}"].tobytes())
                self.tables[lang, int(kind)] = (_summed(keys), columns)

    def find(self, lang: str, kind: int, keys: np.ndarray) -> list[np.ndarray]:
        """Which keys are here, as bits, and the counts of those."""
        own, columns = self.tables.get((lang, kind), (np.empty(0, np.uint64), [np.empty(0, np.uint64)] * COLUMNS[kind]))
        at = np.searchsorted(own, keys)
        seen = np.zeros(len(keys), bool)
        inside = at < len(own)
        seen[inside] = own[at[inside]] == keys[inside]
        return [np.packbits(seen), *(c[at[seen]] for c in columns)]


def discounts(n: dict[int, int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the counts of counts, kept within 0.05 and the count."""
    n = {k: max(1, n.get(k, 0)) for k in (1, 2, 3, 4)}
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), 0.95 * k) for k in (1, 2, 3)])


class Law:
    """A model's discounts, the number of its distinct bigrams, and the share of each word that is not in it."""

    def __init__(self, rows: dict[int, dict]) -> None:
        self.d = {kind: discounts({k: r[f"n{k}"] for k in (1, 2, 3, 4)}) for kind, r in rows.items()}
        one = rows[WORDS]
        self.total = one["total"]
        left = self.d[WORDS] @ [one["n1"], one["n2"], one["types"] - one["n1"] - one["n2"]]
        self.unknown = left / self.total / (one["types"] + 1)  # one unknown token beside the words seen

    def reduced(self, kind: int, n: np.ndarray) -> np.ndarray:
        """Counts less their discounts; 0 stays 0."""
        return np.where(n > 0, n - self.d[kind][np.clip(n, 1, 3) - 1], 0.0)

    def logs(self, grams: Grams, counts: dict[int, np.ndarray]) -> np.ndarray:
        """Natural log of the probability of each distinct trigram's last word. ``counts`` has a row per column and a key in order."""
        one, two, three = (counts[k].astype(np.int64) for k in (WORDS, BIGRAMS, TRIGRAMS))
        p = self.reduced(WORDS, one[0]) / self.total + self.unknown

        def follow(kind: int, n: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
            total = np.maximum(context[1], 1)
            return np.where(context[1] > 0, (self.reduced(kind, n) + (self.d[kind] @ context[2:]) * lower) / total, lower)

        last = grams.two % len(p)
        p2 = follow(BIGRAMS, two[0], one[:, grams.b], p[last])
        return np.log(follow(TRIGRAMS, three[0], two[:, grams.ab], p2[grams.bc]))


#: A pack, its documents and their words, as shard -1; and the answers to it, one row per shard.
PACK = "pack long, lang string, shard int, data binary, stream binary, docs array<long>, langs array<string>, sizes array<long>"
PACK_TYPES = [("pack", pa.int64()), ("lang", pa.string()), ("shard", pa.int32()), ("data", pa.binary()), ("stream", pa.binary()), ("docs", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64()))]


def _make_packs(docs: DataFrame) -> DataFrame:
    most = PACK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, lang, rows in _packs(batches, most):
            words, stream, size = parted(_column(rows, "text"))
            yield _batch([(number, lang, -1, words.tobytes(), squeeze(stream), _column(rows, "doc_id").to_pylist(), _column(rows, "lang").to_pylist(), size.tolist())], PACK_TYPES)

    return docs.mapInArrow(run, PACK)


def _read_pack(row: pa.RecordBatch, i: int) -> Grams:
    size = np.array(row.column("sizes")[i].as_py(), np.int64)
    return Grams(np.frombuffer(row.column("data")[i].as_py(), np.uint64), expand(row.column("stream")[i].as_py())[0].astype(np.int64), size)


def _asked(packs: DataFrame, shards: int) -> DataFrame:
    """Requests: the distinct keys of a pack in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i in range(part.num_rows):
                number, lang = part.column("pack")[i].as_py(), part.column("lang")[i].as_py()
                order = [dealt(keys, shards)[1:] for keys in _read_pack(part, i).keys.values()]
                yield _batch([(s, lang, number, squeeze(*(_sorted(bits[edges[s] : edges[s + 1]]) for bits, edges in order))) for s in range(shards)], PART_TYPES)

    return packs.mapInArrow(run, PART)


def _answered(asked: DataFrame, shards: int, folder: str, names: dict[int, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard] | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part, out = batch.slice(low, 64), []
                for s, lang, number, data in zip(*(part.column(k).to_pylist() for k, _ in PART_TYPES), strict=True):
                    if opened is None or opened[0] != s:
                        opened = (s, Shard(folder, names.get(s)))
                    found = [x for kind, keys in zip(COLUMNS, expand(data), strict=True) for x in opened[1].find(lang, kind, _summed(keys))]
                    out.append((number, lang, s, squeeze(*found), None, None, None, None))
                yield _batch(out, PACK_TYPES)

    return asked.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, PACK)


def _scored(rows: DataFrame, shards: int, laws: dict[str, Law]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _of_shards(batches, "pack"):
            head = parts[0]  # the pack itself comes first
            grams = _read_pack(head, 0)
            lang, sizes = head.column("lang")[0].as_py(), np.array(head.column("sizes")[0].as_py(), np.int64)
            answers = [expand(x.as_py()) for x in _column(parts, "data")[1:]]  # from each shard, in order
            counts = {}
            for kind, keys in grams.keys.items():
                order, _, edges = dealt(keys, shards)
                found = np.zeros((COLUMNS[kind], len(keys)), np.uint32)
                for s, columns in enumerate(answers):
                    seen, own = columns.pop(0), order[edges[s] : edges[s + 1]]
                    found[:, own[np.unpackbits(seen.astype(np.uint8), count=len(own)).astype(bool)]] = [columns.pop(0) for _ in range(COLUMNS[kind])]
                counts[kind] = found
            log = laws[lang].logs(grams, counts)
            total = np.add.reduceat(log[grams.at], grams.begins)
            yield pa.RecordBatch.from_arrays(
                [head.column("docs")[0].values, head.column("langs")[0].values, pa.array([lang] * len(sizes), pa.string()), pa.array(sizes), pa.array(-total / (sizes + 1))], ["doc_id", "lang", "model_lang", "n_tokens", "entropy"]
            )

    dealt_rows = rows.repartition(spread(rows.sparkSession), "pack").sortWithinPartitions("pack", "shard")
    return dealt_rows.mapInArrow(run, "doc_id long, lang string, model_lang string, n_tokens long, entropy double")


def entropies(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, lang, model_lang, n_tokens, entropy)`` per row of ``docs`` under the models of ``texts``.

    Both have ``(doc_id, lang, text, model_lang)``; every model_lang of ``docs`` has a text. Entropy is the mean of -ln p
    over a document's words and its end. Null texts are empty; rows without an id, and repeated ones, are scored one by one.
    """
    spark = docs.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    columns = ("doc_id", "lang", "text", "model_lang")
    counts = materialize(_counts(_trusted_grams(texts.select(*columns), shards), shards), "counts")
    folder = work_dir(spark, "count-shards")
    manifest = _write_shards(counts, shards, folder)
    discard(counts)
    names = {r["shard"]: r["path"] for r in manifest.select("shard", "path").distinct().collect()}  # a row per shard
    told: dict[str, dict[int, dict]] = {}
    for r in manifest.groupBy("lang", "kind").agg(*(F.sum(k).alias(k) for k in ("types", "total", "n1", "n2", "n3", "n4"))).collect():
        told.setdefault(r["lang"], {})[r["kind"]] = r.asDict()
    laws = {lang: Law(rows) for lang, rows in told.items()}
    found = None
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(BLOCKS))
    for i in range(BLOCKS):
        packs = materialize(_make_packs(docs.where(block == i).select(*columns)), "packs")
        answers = _answered(_asked(packs, shards), shards, folder, names)
        scored = materialize(_scored(packs.unionByName(answers), shards, laws), "entropies")
        discard(packs)
        found = scored if found is None else found.unionByName(scored)
    remove(spark, folder)
    discard(manifest)
    return found
