import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import simhash
from loomwork.llm.components import components


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\t", " ").replace("\n", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n\xa0", max_size=60)))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.simhash(text) == slow_fingerprint(text)


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_on_chains_and_stars(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(random.randrange(200, 260), random.randrange(200, 260)) for _ in range(60)] + [(5, 5), (7, 8), (8, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({n for e in edges for n in e}, edges)
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: r for n, r in want.items() if n in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_all_pairs_within_radius(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for k in range(1, 6):
            y = x
            for b in random.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, None, 1), (3, "", 1), (9, "one two", 1), (8, "ONE\ttwo", 2), (8, "ONE\ttwo", 2), (7, long, 0), (6, long + " w9", 0), (None, "one two", 3), (1, "alone here now", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (7, 6), (6, 6), (-1, 8), (1, 1)])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in simhash.one_of_each(df.where("doc_id is not null")).collect())
    assert kept == [1, 3, 6, 8, 8]
