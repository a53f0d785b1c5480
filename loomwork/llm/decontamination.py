"""Benchmark decontamination with DataFrame functions only: windows as long as an item, SimHash, Hamming blocks, exact check.

A window of a document is as many words as the item has, and may begin at any word. A window of similarity 0.8 has shingles
of its item, in any order, at 4/9 of its own and the item's places together; every window with so many is looked at. SimHash
fingerprints of window and item meet in one of their Hamming blocks if they differ in at most ``RADIUS`` bits, and the exact
weighted similarity decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORDS, SIMILAR = 5, 0.8
#: 22 blocks of 64 bits: fingerprints that differ in at most 21 bits agree in a block. Windows of similarity 0.8 differ in
#: 9.7 bits on average, by a binomial law in more than 21 about twice in 100,000.
BLOCKS, RADIUS = 22, 21
#: Benchmark shingles, and documents with a hit, are broadcast up to this many rows (longs and short ids); beyond it they are shuffled.
BROADCAST_ROWS = 500_000

#: Lower-cased words that ASCII white space parts; none for null.
WORD_LIST = r"filter(split(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')"


def _shingles(k: int) -> str:
    """SQL: the hash of each run of ``k`` words of ``words``."""
    return f"case when size(words) >= {k} then transform(sequence(1, size(words) - {k - 1}), i -> xxhash64(slice(words, i, {k}))) else array() end"


#: The longest window whose bits are counted in sixteen numbers of four counters each.
PACKED = 65535


def _simhash(hashes: str) -> str:
    """SQL: a fingerprint of the shingle hashes in an array; a bit is 1 if over half of them have it.

    One pass: number k of sixteen counts bits k, k + 16, k + 32 and k + 48 in its four quarters. Windows too long for that
    are counted bit by bit.
    """
    packed = f"aggregate({hashes}, array_repeat(0L, 16), (c, h) -> zip_with(c, sequence(0, 15), (n, k) -> n + (shiftrightunsigned(h, k) & 281479271743489L)))"
    one = f"aggregate({hashes}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & 1L))"
    fold = "aggregate(transform(sequence(0, 63), b -> if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)"
    quick = f"aggregate(array({packed}), 0L, (x, c) -> {fold.format(ones='(shiftrightunsigned(c[b % 16], 16 * (b div 16)) & 65535L)', hashes=hashes)})"
    return f"if(size({hashes}) <= {PACKED}, {quick}, {fold.format(ones=one, hashes=hashes)})"


def _blocks(fp: str) -> str:
    """SQL: an array of (block, value)."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return "array(" + ", ".join(f"named_struct('block', {i}, 'value', shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + ")"


def _starts(k: int) -> str:
    """SQL: every start of a window with enough of the places ``ats``, ascending, whose shingles the item has too.

    similarity = shared / (a + b - shared) >= 0.8 if 9 shared >= 4 (a + b), and the places in the window are no fewer than shared.
    From each place on, the next ``need`` lie in windows that begin between the last one's farthest start and the first one;
    a window that also holds the place before was told there.
    """
    low = "greatest(0, ats[i + need - 1] - a + 1, if(i = 0, 0, ats[greatest(i - 1, 0)] + 1))"
    high = f"least(ats[i], size - {k - 1} - a)"
    spans = f"transform(filter(sequence(0, size(ats) - need), i -> {low} <= {high}), i -> sequence({low}, {high}))"
    return f"case when size(ats) >= need then flatten({spans}) else array() end"


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _leaks(own: DataFrame, items: DataFrame) -> DataFrame | None:
    """``(key, doc_id, item_id, start, n_words, similarity)`` of every window that is similar; ``own``: key, doc_id, text. None without items."""
    sizes = sorted(r["k"] for r in items.selectExpr(f"least(size(words), {WORDS}) as k").distinct().collect())  # at most five
    found = None
    for k in sizes:
        some = items.where(f"least(size(words), {WORDS}) = {k}").selectExpr("item", "item_id", "size(words) as n_words", f"{_shingles(k)} as shingles")
        some = materialize(some.selectExpr("item", "item_id", "n_words", "shingles", f"{_simhash('shingles')} as fp"), "items")
        places = _small(some.selectExpr("item", "n_words", "explode(array_distinct(shingles)) as shingle"))
        hits = own.selectExpr("key", f"{WORD_LIST} as words").selectExpr("key", "size(words) as size", f"posexplode({_shingles(k)}) as (at, shingle)")
        # shorter texts are one window
        held = hits.join(places, "shingle").groupBy("key", "item", "size", "n_words").agg(F.sort_array(F.collect_set("at")).alias("ats"))
        held = held.selectExpr("*", f"least(size, n_words) - {k - 1} as a").selectExpr("*", f"cast(ceil(4 * (a + n_words - {k - 1}) / 9) as int) as need")
        starts = materialize(held.selectExpr("key", "item", f"explode({_starts(k)}) as start"), "windows")
        touched = _small(starts.select("key").distinct())
        texts = own.join(touched, "key", "left_semi").selectExpr("key", "doc_id", f"{WORD_LIST} as words").selectExpr("key", "doc_id", f"{_shingles(k)} as shingles")
        windows = texts.join(starts, "key").join(_small(some.select("item", "item_id", "n_words")), "item")
        windows = windows.selectExpr("key", "doc_id", "item", "item_id", "start", "n_words", f"slice(shingles, start + 1, n_words - {k - 1}) as shingles").where("size(shingles) > 0")
        windows = windows.selectExpr("*", f"{_simhash('shingles')} as fp")
        met = windows.selectExpr("*", f"inline({_blocks('fp')})").join(
            _small(some.selectExpr("item", "fp as item_fp", f"inline({_blocks('fp')})")), ["item", "block", "value"]
        ).where(f"bit_count(fp ^ item_fp) <= {RADIUS}")
        window = ["key", "doc_id", "item", "item_id", "start"]
        near = met.groupBy(*window, "n_words").agg(F.first("shingles").alias("shingles"))
        # the exact weighted similarity, shingle by shingle: the lesser counts of each, summed, over what both have less these
        counted = near.selectExpr(*window, "n_words", "size(shingles) as a", "explode(shingles) as s").groupBy(*window, "n_words", "a", "s").agg(F.count("*").alias("n"))
        theirs = some.selectExpr("item", "size(shingles) as b", "explode(shingles) as s").groupBy("item", "b", "s").agg(F.count("*").alias("m"))
        shared = counted.join(_small(theirs), ["item", "s"]).groupBy(*window, "n_words", "a", "b").agg(F.sum(F.least("n", "m")).alias("shared"))
        checked = shared.selectExpr(*window, "n_words", "shared / (a + b - shared) as similarity").where(f"similarity >= {SIMILAR}")
        found = checked if found is None else found.unionByName(checked)
    return found


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """``(item, item_id, words)``, repeated rows once; ``item`` tells texts of one id apart."""
    return benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).selectExpr("item_id", f"{WORD_LIST} as words").where("size(words) > 0").distinct().selectExpr("xxhash64(item_id, words) as item", "item_id", "words")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row's key is a hash of its id and text, so that rows that share an id, or have none, stay apart."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, n_words, similarity)``: of each document and item the most similar window of at least 0.8, the first of equals.

    ``start`` counts words from 0. Items of fewer than five words are one shingle. Null or empty texts and items match
    nothing; rows with a null id take part and carry it; repeated rows give one row, and of rows that share an id the best
    window counts. Empty tables: no rows.
    """
    found = _leaks(_keyed(docs, id_col, text_col), _items(benchmark, item_col, item_text_col))
    if found is None:
        return docs.where("false").selectExpr(f"cast(`{id_col}` as long) as doc_id", "cast(null as long) as item_id", "0 as start", "0 as n_words", "cast(0 as double) as similarity")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "n_words")).alias("best"))
    return best.selectExpr("doc_id", "item_id", "-best.col2 as start", "best.n_words as n_words", "best.similarity as similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, each row by its own text; all columns stay."""
    found = _leaks(_keyed(docs, "doc_id", "text"), _items(benchmark, "item_id", "text"))
    if found is None:
        return docs
    held = found.select(F.col("key").alias("leaking_key")).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(held, key == held.leaking_key, "left_anti")
