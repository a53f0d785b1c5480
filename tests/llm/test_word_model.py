import math
import random
from collections import Counter

from loomwork.llm import quality, word_model


def slow(texts, docs):
    """Interpolated modified Kneser-Ney over whole words, from its formulas."""
    grams = lambda t: [(w[i], w[i + 1], w[i + 2]) for w in [["<s>", "<s>", *(t or "").split(), "</s>"]] for i in range(len(w) - 2)]
    c3 = Counter(g for t in texts for g in grams(t))
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter((c,) for _, c in c2)

    def order(counts):
        d = word_model.discounts(Counter(counts.values()))
        below, total = Counter(), Counter()
        for k, v in counts.items():
            below[k[:-1]] += d[min(v, 3) - 1]
            total[k[:-1]] += v
        return lambda k, lower: lower if k[:-1] not in total else ((counts[k] - d[min(counts[k], 3) - 1] if k in counts else 0) + below[k[:-1]] * lower) / total[k[:-1]]

    one, two, three = order(c1), order(c2), order(c3)
    p = lambda a, b, c: three((a, b, c), two((b, c), one((c,), 1 / (len(c1) + 1))))
    return {i: -sum(math.log(p(*g)) for g in grams(t)) / len(grams(t)) for i, t in docs}


def test_all_words_against_formulas(spark, monkeypatch):
    random.seed(11)
    many = [f"w{i}" for i in range(3000)]
    texts = [" ".join(random.choice(many if random.random() < 0.5 else ["the", "of", "x."]) for _ in range(random.randrange(60))) for _ in range(80)]
    docs = list(enumerate([*texts[:5], "zz w1 QQ the of", "the the the the", "", None, " ".join(many[:200])]))
    want = slow(texts, docs)
    monkeypatch.setattr(word_model, "PACK_BYTES", 900)
    frame = lambda rows: spark.createDataFrame([(i, "en", t, m) for i, t in rows for m in ("en", "*")], "doc_id long, lang string, text string, model_lang string").repartition(3)
    got = word_model.entropies(frame(docs), frame(list(enumerate(texts)))).collect()
    assert sorted((r.doc_id, r.model_lang) for r in got) == sorted((i, m) for i, _ in docs for m in ("en", "*"))
    for r in got:
        assert math.isclose(r.entropy, want[r.doc_id], rel_tol=1e-9) and r.n_tokens == len((dict(docs)[r.doc_id] or "").split())


def test_rare_words_stay_words(spark):
    random.seed(2)
    rare = [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzaeio" for d in "mnopqr"]
    known, other = rare[::2], rare[1::2]  # the same shapes, 3000 words each, none with 1/2000 of the text
    text = lambda words: " ".join(random.choices(words, k=100))
    docs = [(i, "en", text(known)) for i in range(300)] + [(1000 + i, "en", text(other)) for i in range(20)]
    labels = [(i, 1, 0) for i in range(0, 300)]
    found = {r.doc_id: r for r in quality.scores(spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(2), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert max(found[i].perplexity for i in range(300)) < min(found[i].perplexity for i in range(1000, 1020))
    assert all(found[i].rejected for i in range(1000, 1020))


def test_rare_languages_have_the_pooled_bound(spark):
    random.seed(8)
    text = lambda mark: " ".join(random.choices(["the", "of", "and", "to", "in"], k=100) if not mark else [f"{mark}{random.random()}" for _ in range(100)])
    docs = [(i, "en", text("")) for i in range(200)] + [(1000, "xx", text("junk")), (1001, "xx", text(""))]
    labels = [(i, 1, 0) for i in range(200)]
    rows = quality.scores(spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and found[1001].bound == found[1000].bound is not None
    assert found[1000].rejected and not found[1001].rejected
