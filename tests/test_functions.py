import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import codecs, hashing, scalars


@given(st.lists(st.one_of(st.none(), st.binary(max_size=40)), max_size=20))
@settings(max_examples=50, deadline=None)
def test_many_hashes_are_single_hashes(values):
    assert hashing.fnv1a64_many(values).tolist() == [hashing.fnv1a64(v or b"") for v in values]


def test_known_hash():
    assert hashing.fnv1a64(b"abc") == 0xE71FA2190541574B


def test_envelope_bytes_and_errors():
    raw = codecs.seal(0x0102030405060708, 9, b"abc")
    assert raw[:22] == b"SPND" + bytes([0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 0, 0, 0, 9, 0, 0, 0, 3])
    assert codecs.unseal(raw, 3) == (0x0102030405060708, 9, b"abc")
    for bad, most, why in ((raw[:20], 3, "Truncated"), (b"X" + raw[1:], 3, "InvalidMagic"), (raw[:5] + b"\2" + raw[6:], 3, "UnsupportedFormat"), (raw, 2, "LengthTooLarge"), (raw + b"x", 3, "LengthMismatch"), (raw[:29] + bytes([raw[29] ^ 1]) + raw[30:], 3, "ChecksumMismatch")):
        with pytest.raises(codecs.FormatError, match=why):
            codecs.unseal(bad, most)


@given(st.binary(max_size=80))
@settings(max_examples=200, deadline=None)
def test_foreign_bytes_never_pass(raw):
    for read in (lambda: codecs.unseal(raw, 100), lambda: codecs.unpack_archive(raw)):
        with pytest.raises(codecs.FormatError):
            read()


def test_archive_round_trip_and_errors():
    records = [codecs.ArchiveRecord(i, 2, i * 10, 7, 1, bytes([i])) for i in range(5, 9)]
    raw = codecs.pack_archive(records)
    assert raw[:12] == b"SPAR" + bytes([0, 0, 0, 1, 0, 0, 0, 4])
    assert codecs.unpack_archive(raw) == records
    with pytest.raises(codecs.FormatError, match="InvalidSequence"):
        codecs.pack_archive([records[0], records[2]])
    with pytest.raises(codecs.FormatError, match="EmptyArchive"):
        codecs.pack_archive([])
    with pytest.raises(codecs.FormatError, match="ChecksumMismatch"):
        codecs.unpack_archive(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_payload_bytes():
    child = codecs.pack_child(0x0102030405060708, 9, 10, 11, 2, b"input")
    assert child == bytes([1, 2, 3, 4, 5, 6, 7, 8, 0, 0, 0, 9, 0, 0, 0, 0, 0, 0, 0, 10, 0, 0, 0, 11, 2]) + b"input"
    assert codecs.unpack_child(child) == (0x0102030405060708, 9, 10, 11, 2, b"input")
    with pytest.raises(codecs.FormatError):
        codecs.unpack_child(b"bad")
    assert codecs.pack_migration(4, 0x0102030405060708, b"op", b"why") == bytes([0, 0, 0, 4, 1, 2, 3, 4, 5, 6, 7, 8, 0, 2, 0, 3]) + b"opwhy"
    assert codecs.pack_termination(b"a", b"done") == bytes([0, 1, 0, 4]) + b"adone"
    assert codecs.unpack_timer(codecs.pack_timer(100, b"x")) == (100, b"x")


def test_ids():
    raw = bytes.fromhex("0123456789abcdeffedcba9876543210")
    assert codecs.format_id(raw) == "01234567-89ab-cdef-fedc-ba9876543210"
    assert codecs.parse_id("01234567-89AB-cdef-fedc-ba9876543210") == raw
    with pytest.raises(codecs.FormatError):
        codecs.parse_id("0123456789abcdeffedcba9876543210")
    make = codecs.IdGenerator(random.Random(1))
    made = [make.next(ms) for ms in [5, 5, 3, 9, *[9] * 5000]]
    assert made == sorted(made) and len(set(made)) == len(made) and all(x[6] >> 4 == 7 and x[8] >> 6 == 2 for x in made)
    assert codecs.derived_id(raw, 1, 1, 6) != codecs.derived_id(raw, 15, 1, 8)


def delay(attempt, seed, initial, most, percent):
    if attempt <= 0:
        return 0
    d = min(initial * 2 ** (attempt - 1), most)
    span = d // 100 * percent
    return d if span == 0 else d - span + seed % (2 * span + 1)


def test_scalars_against_plain_python(spark):
    rows = [(a, s, v, c) for a in range(0, 9) for s in (0, 17, 12345) for v, c in ((0, (1 << 32) - 1), (5, 5), (1, 2), (1 << 31, 0), ((1 << 31) - 1, 0))]
    df = spark.createDataFrame(rows, "attempt int, seed long, v long, c long")
    out = df.select("*", scalars.backoff_ms(F.col("attempt"), F.col("seed"), 100, 900, 20).alias("d"), scalars.is_newer(F.col("v"), F.col("c")).alias("newer"), scalars.next_tick(F.col("c")).alias("next")).collect()
    for r in out:
        assert r.d == delay(r.attempt, r.seed, 100, 900, 20)
        assert r.newer == (1 <= (r.v - r.c) % (1 << 32) <= (1 << 31) - 1)
        assert r.next == (r.c + 1) % (1 << 32)


def test_moving_mean_histogram_retry(spark):
    df = spark.createDataFrame([([80, 160],), ([80],), ([],)], "s array<long>")
    assert [r[0] for r in df.select(scalars.moving_mean(F.col("s"))).collect()] == [90, 80, None]
    places = spark.range(0, 8).select(scalars.histogram_place(F.col("id"), [2, 5])).collect()
    assert [r[0] for r in places] == [0, 0, 0, 1, 1, 1, 2, 2]
    tried = spark.createDataFrame([(1, "application", 9), (1, "application", 1), (3, "application", 1), (1, "non_retryable", 1)], "a int, k string, c int")
    assert [r[0] for r in tried.select(scalars.should_retry(F.col("a"), F.col("k"), F.col("c"), 3, [9])).collect()] == [False, True, False, False]
    classes = spark.createDataFrame([(0,), (4,), (6,), (8,), (99,)], "c int").select(scalars.error_class(F.col("c"))).collect()
    assert [r[0] for r in classes] == ["none", "cancelled", "transient", "corruption", "permanent"]


def test_chunks_cover_the_range():
    for n in (0, 1, 63, 64, 137, 1000):
        chunks = scalars.chunk_geometry(n, 4)
        assert [i for a, b in chunks for i in range(a, b)] == list(range(n))
    assert scalars.chunk_geometry(137, 4, 11)[-1] == (132, 137)
    with pytest.raises(ValueError):
        scalars.chunk_geometry(5, 1, 0)


def test_checkpoint_due(spark):
    df = spark.createDataFrame([(10, 73, "running"), (10, 74, "running"), (10, 11, "completed"), (10, 11, "waiting")], "s long, n long, st string")
    assert [r[0] for r in df.select(scalars.checkpoint_due(F.col("s"), F.col("n"), F.col("st"))).collect()] == [False, True, True, True]


def test_fingerprint_needs_sorted_names(spark):
    col = F.lit
    with pytest.raises(ValueError):
        hashing.fingerprint(col("k"), col(1), col("p"), [], col("t"), [("b", col("1")), ("a", col("2"))])
    import hashlib
    import struct

    frame = lambda b: struct.pack(">Q", len(b)) + b
    want = hashlib.sha256(frame(b"k") + struct.pack(">I", 3) + frame(b"p") + struct.pack(">QQQ", 1, 5, 6) + frame(b"t") + frame(b"a") + frame(b"1")).hexdigest()
    got = spark.range(1).select(hashing.fingerprint(col("k"), col(3), col("p"), [(col(5), col(6))], col("t"), [("a", col("1"))])).first()[0]
    assert got == want
