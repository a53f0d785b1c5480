"""Near-duplicates by SimHash and exact similarity: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 are linked.

First SimHash: texts get 64-bit fingerprints of their five-word shingles, pigeonring chains bring together those that differ
in three bits or fewer, the full Hamming check follows, then the exact similarity of the sets, and what is linked becomes one group.

The exact way for the rest: at a similarity of 0.8 fingerprints differ in about ten bits, where no chain of their segments is
a selective key. So pairs of different groups which fingerprints did not bring together, and only these, come from prefixes:
with the shingles of all texts in one order, two such sets share one of each text's first n - ceil(0.8 n) + 1. Any order
loses no pair; shingles frequent in a sample come last, so that passages which many texts hold make no candidates.

Where many texts share a prefix shingle they are not compared all with all at first: each meets one other text of the
shingle, and what is linked becomes one group. In the first round that is the text of whose prefix most is shared, as
what copies of one text have in common is that text; in later ones it changes. Then texts of different groups meet, each
pair once, so no link between groups is lost, and a cluster of near copies costs a few comparisons a text. A pair is compared
in full only if all bounds still allow 0.8: the 1024 slots of shingles that only one of both texts uses, its shared prefix
shingles with what may follow the last of them, and the lesser counts of both texts in each of the 256 bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialize, slices
from .components import components
from .simhash import fingerprint_of, links as near_fingerprints, shingle_hashes

WORDS = 5
#: One text of so many is sampled; a shingle in so many of these comes last in the order; at most so many are kept.
SAMPLED, FREQUENT, MOST = 16, 3, 200_000
#: Shingles of more than HEAVY texts of several groups are met in rounds first, so many at most, and until a round links under one in STALE pairs.
ROUNDS, HEAVY, STALE = 12, 64, 20
BINS, SLOTS = 256, 1024
USED = tuple(f"u{k}" for k in range(SLOTS // 64))
#: Fingerprints link at so many differing bits or fewer.
RADIUS = 3
#: Bits of the map by which the rows of candidates are found again in one scan: 2 MB whatever the input; a bit too many only costs work.
MAP_BITS = 1 << 24


def own_shingles(text: str | None, hashes: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """A key of the text's words, 0 for none, and its distinct shingles, ascending; ``hashes`` are its shingles, where they are at hand."""
    found = np.unique((shingle_hashes(text, WORDS) if hashes is None else hashes).view(np.int64))
    key = xxhash.xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())) if len(found) else 0
    return key - (1 << 64) if key >> 63 else key, found


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, raw)``: ``raw`` is a hash of the text as it stands, by which its rows can be found again without parting words."""
    return id_and_text(docs, "doc_id", "text").withColumn("raw", F.xxhash64("text"))


def sets(rows: DataFrame, held: Broadcast | None = None) -> DataFrame:
    """``(text_key, n, shingles)`` per row of ``(doc_id, text, raw)``; with a bit map of ``raw`` only of rows that it has, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            if held is not None:
                raw = part.column(1).to_numpy()
                bit = raw & (MAP_BITS - 1)
                pick = np.flatnonzero((held.value[bit >> 6] >> (bit & 63)) & 1)
                pick = [i for i in pick.tolist() if raw[i] not in seen]
                seen = seen if len(seen) < 1_000_000 else set()
                seen.update(raw[pick].tolist())
                part = part.take(pa.array(pick, pa.int64()))
            found = [own_shingles(t) for t in part.column(0).to_pylist()]
            size = np.fromiter((len(x) for _, x in found), np.int32, len(found))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array(size), lists], ["text_key", "n", "shingles"])

    return rows.select("text", "raw").mapInArrow(run, "text_key long, n int, shingles array<long>")


def _bit_map(raws: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits of the longs ``raw``, combined before it comes to the driver."""
    words = raws.selectExpr(f"raw & {MAP_BITS - 1}L as bit").selectExpr("bit div 64 as word", "shiftleft(1L, cast(bit % 64 as int)) as one").groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def prefixes(rows: DataFrame) -> DataFrame:
    """``(doc_id, raw, text_key, n, fp, bins, prefix)`` per row: the first shingles in the order of all texts, in which those frequent in a sample come last.

    ``fp`` is the SimHash fingerprint. ``bins`` counts the shingles by their last byte, a byte each; null where a count is
    larger. ``u0`` to ``u15`` tell which of 1024 slots, by the last ten bits, are used.
    """
    sample = sets(rows.where(F.pmod("raw", F.lit(SAMPLED)) == 0)).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    last = np.array(sorted(r["h"] for r in sample.where(f"n >= {FREQUENT}").orderBy(F.desc("n"), "h").limit(MOST).collect()), np.int64)
    held = rows.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = held.value
        for part in slices(batches):
            keys, prints, firsts, size, bins, used = [], [], [], [], [], []
            for text in part.column(1).to_pylist():
                hashes = shingle_hashes(text, WORDS)
                prints.append(fingerprint_of(hashes))
                key, own = own_shingles(text, hashes)
                n = len(own)
                keys.append(key)
                size.append(n)
                counts = np.bincount(own & (BINS - 1), minlength=BINS)
                bins.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else None)
                slots = np.zeros(SLOTS, bool)
                slots[own & (SLOTS - 1)] = True
                used.append(np.packbits(slots).view(np.int64))
                frequent = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own if len(late) else np.zeros(n, bool)
                firsts.append(np.concatenate([own[~frequent], own[frequent]])[: n - -(-4 * n // 5) + 1] if n else own)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bins, pa.binary()), lists, *map(pa.array, np.array(used).T.copy())], ["doc_id", "raw", "text_key", "n", "fp", "bins", "prefix", *USED])

    return rows.mapInArrow(run, f"doc_id long, raw long, text_key long, n int, fp long, bins binary, prefix array<long>, {', '.join(f'{u} long' for u in USED)}")


#: SQL: how many shingles the prefix of a set of ``n`` has.
PREFIX = "n - (4 * n + 4) div 5 + 1"
#: SQL: two sets of these sizes can be similar.
RATIO = "5 * least({0}, {1}) >= 4 * greatest({0}, {1})"
#: SQL: so can two sets less at least one shingle for each slot that only one of them uses.
_ALONE = " + ".join(f"bit_count({{0}}_{u} & ~{{1}}_{u})" for u in USED)
OVERLAP = f"9 * least(na - ({_ALONE.format('a', 'b')}), nb - ({_ALONE.format('b', 'a')})) >= 4 * (na + nb)"


def _with_links(groups: DataFrame, pairs: DataFrame, found: DataFrame, rows: DataFrame) -> tuple[DataFrame, int, int]:
    """``groups`` (text_key, root) after the links among ``pairs`` (a, b, root_a, root_b) of texts whose sets have a similarity of at least 0.8; how many pairs, and links between groups, there were."""
    counts = found.groupBy("text_key").agg(F.first("bins").alias("bins"), F.first("n").alias("n"))
    own, their = counts.selectExpr("text_key as a", "n as na", "bins as x"), counts.selectExpr("text_key as b", "n as nb", "bins as y")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose lesser counts, bin by bin, are enough."""
        for part in slices(batches, 4096):
            x, y = part.column("x"), part.column("y")
            known = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False))
            most = np.full(part.num_rows, 1 << 40, np.int64)
            if len(known):
                x, y = (np.frombuffer(b"".join(c.take(pa.array(known)).to_pylist()), np.uint8).reshape(-1, BINS) for c in (x, y))
                most[known] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            both = part.column("na").to_numpy().astype(np.int64) + part.column("nb").to_numpy()
            yield part.filter(pa.array(9 * most >= 4 * both)).select(["a", "b", "root_a", "root_b"])

    pairs = materialize(pairs, "pairs")
    n_pairs = pairs.count()
    met = pairs.join(own.hint("merge"), "a").join(their.hint("merge"), "b").select("a", "b", "root_a", "root_b", "na", "nb", "x", "y")
    pairs = materialize(met.mapInArrow(possible, "a long, b long, root_a long, root_b long"), "candidates")
    wanted = pairs.selectExpr("inline(array(struct(a as text_key), struct(b as text_key)))").distinct()
    raw = found.join(wanted.hint("merge"), "text_key", "left_semi").groupBy("text_key").agg(F.min("raw").alias("raw")).select("raw")
    held = rows.sparkSession.sparkContext.broadcast(_bit_map(raw))
    texts = sets(rows, held).join(wanted.hint("merge"), "text_key", "left_semi")
    texts = materialize(texts.groupBy("text_key").agg(F.first("shingles").alias("shingles")), "candidate-sets")
    held.destroy()
    own, their = texts.selectExpr("text_key as a", "shingles as x"), texts.selectExpr("text_key as b", "shingles as y")
    met = pairs.join(own.hint("merge"), "a").join(their.hint("merge"), "b").selectExpr("root_a as a", "root_b as b", "size(x) + size(y) as both", "size(array_intersect(x, y)) as shared")
    links = materialize(met.where("5 * shared >= 4 * (both - shared)").select("a", "b").distinct(), "links")
    n_links = links.count()
    discard(texts, pairs)
    roots = components(links).withColumnRenamed("root", "_to")
    return materialize(groups.join(roots, groups["root"] == roots["node"], "left").select("text_key", F.coalesce("_to", "root").alias("root")), "groups"), n_pairs, n_links


#: SQL: the fingerprints of these two texts have brought them together; ``lead`` tells the text that stands for its fingerprint.
MET = f"a_lead and b_lead and bit_count(a_fp ^ b_fp) <= {RADIUS}"


def leads(found: DataFrame) -> DataFrame:
    """``(text_key, fp, top)`` of each text with words; ``top`` is the text that stands for the texts of its fingerprint."""
    texts = found.where("n > 0").groupBy("text_key").agg(F.first("fp").alias("fp"))
    tops = texts.groupBy("fp").agg(F.min("text_key").alias("top"))
    return materialize(texts.join(tops.hint("merge"), "fp").select("text_key", "fp", "top"), "leads")


def fingerprint_pairs(led: DataFrame) -> DataFrame:
    """``(a, b)`` of texts that SimHash brings together: each with the one that stands for its fingerprint, and these where fingerprints differ in RADIUS bits or fewer."""
    tops = led.where("text_key = top").select("fp", "top")
    near = near_fingerprints(tops.select("fp"), RADIUS).toDF("fa", "fb")
    near = near.join(tops.toDF("fa", "a").hint("merge"), "fa").join(tops.toDF("fb", "b").hint("merge"), "fb").select("a", "b")
    return led.where("text_key <> top").selectExpr("text_key as a", "top as b").unionByName(near)


def linked(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``(text_key, root)`` of the texts that share a prefix shingle with another text; equal roots are linked, directly or over others."""
    texts = found.where("n > 0").groupBy("text_key").agg(F.min("raw").alias("raw"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    flat = materialize(texts.select("text_key", "n", F.posexplode("prefix").alias("at", "h")), "prefix-shingles")
    ends = flat.groupBy("h").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low < high").select("h")
    shared = materialize(flat.join(ends.hint("merge"), "h", "left_semi"), "shared-shingles")
    discard(flat)
    keys = materialize(shared.groupBy("text_key").agg((F.count("*") / F.expr(f"first({PREFIX})")).alias("common")), "candidate-keys")
    groups = materialize(keys.select("text_key", F.col("text_key").alias("root")), "groups")
    led = leads(found)
    groups, _, _ = _with_links(groups, fingerprint_pairs(led).selectExpr("a", "b", "a as root_a", "b as root_b"), found, rows)
    for number in range(ROUNDS):
        now = shared.join(groups.hint("merge"), "text_key").join(keys.hint("merge"), "text_key").select("h", "text_key", "n", "root", "common")
        # one text of each shingle that many texts of several groups have
        turn = F.struct((F.lit(0.0) if number else -F.col("common")).alias("c"), F.xxhash64("text_key", F.lit(number)).alias("t"), "text_key", "n", "root")
        heads = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(turn).alias("head"), F.count("*").alias("m")).where(f"m > {HEAVY} and low < high")
        heads = materialize(heads.selectExpr("h", "head.text_key as b", "head.n as nb", "head.root as root_b"), "heads")
        if not heads.take(1):
            break
        pairs = now.join(heads.hint("merge"), "h").where(f"root <> root_b and {RATIO.format('n', 'nb')}").selectExpr("text_key as a", "b", "root as root_a", "root_b").distinct()
        groups, met, made = _with_links(groups, pairs, found, rows)
        if STALE * made < met:
            break
    now = shared.join(groups.hint("merge"), "text_key")
    several = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    uses = found.groupBy("text_key").agg(*(F.first(u).alias(u) for u in USED)).join(led.selectExpr("text_key", "fp", "text_key = top as lead").hint("merge"), "text_key")
    open_ = materialize(now.join(several.hint("merge"), "h", "left_semi").join(uses.hint("merge"), "text_key"), "open")
    x, y = (open_.selectExpr("h", f"text_key as {k}", f"n as n{k}", f"at as at_{k}", f"root as root_{k}", *(f"{u} as {k}_{u}" for u in ("fp", "lead", *USED))) for k in "ab")
    met = x.join(y.hint("merge"), "h").where(f"a < b and root_a <> root_b and {RATIO.format('na', 'nb')} and {OVERLAP} and not ({MET})").groupBy("a", "b", "na", "nb", "root_a", "root_b").agg(F.count("*").alias("c"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    pairs = met.where("9 * (c + least(na - at_a, nb - at_b) - 1) >= 4 * (na + nb)").select("a", "b", "root_a", "root_b")
    return _with_links(groups, pairs, found, rows)[0]


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` per row: component_id is the least doc_id linked directly or over others.

    Texts of the same words are one node, those without words too. A null doc_id takes part only with others' ids.
    """
    rows = _rows(docs)
    found = materialize(prefixes(rows), "prefixes")
    roots = linked(found, rows)
    nodes = materialize(found.groupBy("text_key").agg(F.min("doc_id").alias("least")), "text-nodes")
    grouped = nodes.join(roots.hint("merge"), "text_key")
    moved = grouped.select("text_key", "root").join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("text_key", "component_id")
    named = materialize(nodes.join(moved, "text_key", "left").select("text_key", F.coalesce("component_id", "least").alias("component_id")), "text-groups")
    return found.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id names their group, all columns. Rows without a doc_id stay; rows that repeat a doc_id stay or go together."""
    kept = groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
