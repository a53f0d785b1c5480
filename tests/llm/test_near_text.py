import random

import corpus_pipeline
import pytest
from test_simhash_components import union_find

from loomwork.llm import near_text


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("rounds", "heavy"), [(6, 64), (6, 2), (1, 1)])
def test_pipeline_stage_against_brute_force(spark, monkeypatch, rounds, heavy):
    monkeypatch.setattr(near_text, "SAMPLED", 2)
    monkeypatch.setattr(near_text, "ROUNDS", rounds)
    monkeypatch.setattr(near_text, "HEAVY", heavy)
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    line = [word() for _ in range(30)]
    docs = [(0, None, 1), (1, "", 1), (2, "One two", 1), (3, "one TWO", 1), (4, "one three", 1)]
    for _ in range(25):
        body = [word() for _ in range(random.choice([20, 60, 200]))] + line * random.randrange(2)
        for edits in (0, 0, 1, 2, 4, 6, 9):
            w = list(body)
            for _ in range(edits):
                w[random.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w), edits))
    own = [shingles(t) for _, t, _ in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if own[i] == own[j] or len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    want = union_find(range(len(docs)), near)
    df = spark.createDataFrame([*docs, (None, docs[9][1], 7)], "doc_id long, text string, edits int").repartition(3)
    assert {r.doc_id: r.component_id for r in near_text.groups(df).collect() if r.doc_id is not None} == want
    kept = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, *{d for d, top in want.items() if d == top}], key=repr)
    assert near_text.groups(df.limit(0)).count() == 0


def test_fingerprints_meet_first_and_a_cluster_stays_cheap(spark, monkeypatch):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    body, docs = [word() for _ in range(150)], []
    for edits, copies in ((0, 1), (1, 40), (3, 80), (8, 60)):  # those of eight edits are near the body's similarity of 0.6
        for _ in range(copies):
            w = list(body)
            for at in random.sample(range(150), edits):
                w[at] = word()
            docs.append((len(docs), " ".join(w)))
    own = [shingles(t) for _, t in docs]
    want = union_find(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])])
    compared, near = [], []
    write, links = near_text.materialize, near_text.near_fingerprints

    def materialize(df, label, *more):
        out = write(df, label, *more)
        if label == "pairs":
            compared.append(out.count())
        return out

    def near_fingerprints(fps, radius):
        near.append(radius)
        return links(fps, radius)

    monkeypatch.setattr(near_text, "materialize", materialize)
    monkeypatch.setattr(near_text, "near_fingerprints", near_fingerprints)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_text.groups(df).collect()} == want
    assert near == [3] and sum(compared) < 10 * len(docs)

    found = near_text.prefixes(near_text._rows(df))
    led = near_text.leads(found)
    print_of = {r.text_key: r.fp & ((1 << 64) - 1) for r in led.collect()}
    top = {r.text_key for r in led.where("text_key = top").collect()}
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in near_text.fingerprint_pairs(led).collect() if {r.a, r.b} <= top}
    assert pairs == {(a, b) for a in top for b in top if a < b and (print_of[a] ^ print_of[b]).bit_count() <= 3}
