import random
from collections import Counter

import pytest

from loomwork.llm import decontamination, quality, suffix_dedup


def removed(texts, length=100):
    return suffix_dedup.brute_force([(t or "").encode() for t in texts], length)


def messy_texts():
    random.seed(7)
    letters = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    shared, line = letters(300), letters(60)
    texts = [None, "", "short", letters(99), letters(100), "ab" * 400, shared, shared, letters(50) + shared + letters(50), shared[:150] + letters(5) + shared[150:], letters(400) + line, line + letters(400)]
    texts += [letters(30) + line + letters(200) + line for _ in range(4)] + [texts[8]] + [shared[random.randrange(150) :][: random.randrange(100, 250)] for _ in range(8)]
    return texts


@pytest.mark.parametrize(("hot", "hotter"), [(50_000, 20), (3, 20), (1, 3), (0, 1)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot, hotter):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOTTER", hotter)
    texts = messy_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(df).collect()}
    for i, (t, gone) in enumerate(zip(texts, removed(texts), strict=True)):
        raw = (t or "").encode()
        assert bytes(got[i].kept) == bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw), sum(gone), sum(g and not p for p, g in zip([False, *gone], gone)))


def test_blocks_and_chunks_do_not_matter(spark, monkeypatch):
    texts = messy_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((r.doc_id, bytes(r.kept)) for r in suffix_dedup.deduplicate(df).collect())
    for name, value in (("CHUNK_BYTES", 130), ("BLOCK_BYTES", 1), ("SORT_ROWS", 50), ("SEEN", 1)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert sorted((r.doc_id, bytes(r.kept)) for r in suffix_dedup.deduplicate(df).collect()) == want


def test_suffix_dedup_repeated_ids(spark):
    text = "".join(random.Random(1).choices("abc ", k=200))
    df = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, text, 3), (2, "é" * 80, 4)], "doc_id long, text string, kept int")
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.deduplicate(df).collect()), key=repr)
    assert got == sorted([(None, 0), (1, 200), (1, 200), (2, sum(removed(["é" * 80])[0]))], key=repr)
    cut = suffix_dedup.without_repeats(df)
    assert cut.columns == df.columns and sorted(len(r.text) for r in cut.collect())[:2] == [0, 0]
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0


def plain_leaks(docs, items):
    found = {}
    shingle = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    for d, text in docs:
        words = (text or "").lower().split()
        for item, body in items:
            own = (body or "").lower().split()
            k = min(5, len(own))
            if not own or len(words) < k:
                continue
            b, best = Counter(shingle(own, k)), None
            for at in range(max(1, len(words) - len(own) + 1)):
                a = Counter(shingle(words[at : at + len(own)], k))
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 and (best is None or s > best[0]):
                    best = (s, at)
            if best:
                found[d, item] = best
    return found


def test_leaks_against_brute_force(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 15, 50, 4, 1])] + [(9, None), (10, "")]
    items[4] = (4, "zzzz")
    docs = []
    for i in range(40):
        body = [word() for _ in range(80)]
        if i % 2:
            leak = items[i % 4][1].split()
            if i % 3 == 0 and len(leak) > 20:
                leak[-1] = "changed"
            if i % 5 == 0 and len(leak) > 20:
                leak[len(leak) // 2] = "other"
            at = random.choice([0, 40, 80])
            body[at:at] = leak
        docs.append((i, " ".join(body).upper() if i % 4 == 1 else "\n".join(body)))
    docs += [(50, None), (51, ""), (52, items[1][1]), (53, "zzzz"), (None, items[0][1]), (54, " ".join([items[1][1]] * 3))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_leaks(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontamination.leaks(df, none).count() == 0 and decontamination.without_leaks(df, none).count() == len(docs)
    assert decontamination.leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_quality_keeps_good_and_drops_junk(spark):
    random.seed(1)
    words = "the of and to in was for with that this".split()
    good = lambda: " ".join(random.choice(words) if random.random() < 0.6 else "".join(random.choice("lmnoprst") for _ in range(6)) for _ in range(120))
    docs = [(i, good(), "en", 9) for i in range(300)] + [(1000 + i, good().upper().replace(" ", "!! "), "en", 9) for i in range(20)] + [(2000, None, None, None), (2001, "", "xx", 0), (None, good(), "en", 9)]
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(1000, 0, 0), (None, 1, 0), (5, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, entropy int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_good(df, lab).collect()}
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(1000, 1020))
    assert quality.keep_good(df, lab.limit(0)).count() == len(docs)
    assert quality.scores(df.limit(0), lab).count() == 0


def test_quality_judges_rows_without_id_alone(spark):
    random.seed(4)
    words = "the of and to in was for with that this".split()
    good = lambda: " ".join(random.choices(words, k=100))
    junk = lambda: " ".join(f"q{random.random()}" for _ in range(100))
    docs = [(i, good(), "en") for i in range(200)] + [(None, junk(), "en") for _ in range(5)] + [(None, good(), "en")]
    kept = quality.keep_good(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    assert [r.text for r in kept.where("doc_id is null").collect()] == [docs[-1][1]]
