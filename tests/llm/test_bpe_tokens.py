import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import bpe, token_files
from loomwork.llm.common import work_dir

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from(["the", "thing", " ", "  ", "\n", "it's", "I'LL", "é", "İ", "ΣΑΣ", "x" * 60, "<|endoftext|>", "<|startoftext|>", "123", "½", "日本", "😀", "\x85", "\xa0", "\x1c", "'s", "!!", "\t", "́"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def word():
    return bpe.WordBPE(WORD), Tokenizer.from_file(WORD)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_word_bpe_is_the_library(word, text):
    mine, library = word
    ids, decoded = mine.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_merge_skips_stale_entries():
    # a b c: (b, c) first, so the queued (a, b) is stale
    ranks = {1 << bpe.KEY | 2: (1, 10), 2 << bpe.KEY | 3: (0, 11), 1 << bpe.KEY | 11: (2, 12)}
    assert bpe.merge([1, 2, 3], ranks) == [12]
    assert bpe.merge([1, 2, 1, 2], ranks) == [10, 10]
    assert bpe.merge([3], ranks) == [3]


def test_digests_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "the thing"), (4, "the thing"), (4, "the thing"), (5, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = bpe.digests(df, WORD).collect()
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(df.limit(0), WORD).count() == 0


@given(st.lists(st.one_of(st.none(), PIECES), max_size=6))
@settings(max_examples=150, deadline=None)
def test_byte_encoder_is_the_library(texts):
    encoder, library = token_files.loaded(BYTE), Tokenizer.from_file(BYTE)
    found = encoder.encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=400), st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=20))
@settings(max_examples=50, deadline=None)
def test_perfect_hash_is_minimal(keys, foreign):
    own = np.array(sorted(keys), np.int64)
    perfect = token_files.PerfectHash.of(own)
    assert sorted(perfect.slots(own).tolist()) == list(range(len(own)))
    assert all(-1 <= s < max(1, len(own)) for s in perfect.slots(np.array(foreign, np.int64)).tolist())


def test_token_shards(spark):
    rows = [(7, "the thing it's"), (3, None), (9, ""), (7, "other text"), (None, "no key"), (-5, "x " * 3000), (4, " lead  and tail ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = work_dir(spark, "tokens-test")
    manifest = token_files.write_tokens(df, BYTE, folder)
    got = sorted(map(tuple, token_files.read_tokens(manifest, folder).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(BYTE)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r[0] for r in got] == [None, -5, 3, 4, 7, 7, 9]
    at = 0
    for i, start, n, crc in got:
        fits = [x for x in (ids(t) for k, t in rows if k == i) if (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) == (n, crc)]
        assert fits and start == at
        at += n
    tokens = token_files.Tokens(manifest, folder)
    assert tokens.read(-5).tolist() == ids("x " * 3000) and len(tokens.open) == 1
    assert tokens.read(4).tolist() == ids(" lead  and tail ") and tokens.read(12345) is None and tokens.read(-6) is None
    assert tokens.read(7).tolist() in [ids(t) for k, t in rows if k == 7]
    empty = token_files.write_tokens(df.limit(0), BYTE, work_dir(spark, "tokens-none"))
    assert empty.count() == 0


def test_two_attempts_do_not_mix(spark):
    df = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(200)], "doc_id long, text string").repartition(3)
    folder = work_dir(spark, "tokens-twice")
    first, second = (token_files.write_tokens(d, BYTE, folder) for d in (df, df.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" more")))))
    library = Tokenizer.from_file(BYTE)
    for manifest, rows in ((first, df), (second, df.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" more"))))):
        got = {r.doc_id: r.n_tokens for r in token_files.read_tokens(manifest, folder).collect()}
        assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows.collect()}


def test_a_key_of_many_rows_is_parted(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5, id)) as doc_id", "concat('text ', id) as text").repartition(5)
    folder = work_dir(spark, "tokens-hot")
    manifest = token_files.write_tokens(df, BYTE, folder)
    assert manifest.agg(F.max("n_docs")).first()[0] < 1500
    found = token_files.read_tokens(manifest, folder).orderBy("start").collect()
    assert len(found) == 3000 and [r.doc_id is None for r in found] == sorted((r.doc_id is None for r in found), reverse=True)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:]))
    assert token_files.Tokens(manifest, folder).read(5) is not None
