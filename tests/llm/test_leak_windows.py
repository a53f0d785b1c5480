import random
import time

from pyspark.sql import functions as F
from test_text_stages import plain_leaks

from loomwork.llm import decontamination


def test_every_start_of_a_window(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    items = [(n, " ".join(word() for _ in range(n))) for n in (40, 50, 59, 5, 7)]
    docs = []
    for n, text in items:
        w = text.split()
        for before in (0, 3, 30):  # the halves in the other order, alone, near the start, within, doubled, and with words between
            around = [word() for _ in range(before)]
            for body in (w[n // 2 :] + w[: n // 2], w * 2, w[n // 2 :] + w[: n // 2] + w[n // 2 :], w[: n // 2] + ["new"] + w[n // 2 :], w[1:], w[:-2]):
                docs.append((len(docs), " ".join(around + body + around)))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_leaks(docs, items)
    assert got == want
    assert {(i, 40) for i in (0, 6, 12)} <= set(got)  # halves swapped


def test_documents_without_id_go_by_their_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, "so " + item, 1), (None, "clean words of its own here", 2), (None, None, 3), (7, item, 4), (8, "clean", 5)], "doc_id long, text string, leak int")
    kept = decontamination.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.leak for r in kept.collect()) == [2, 3, 5]


def test_repeated_rows_and_long_items(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    long_ = [word() for _ in range(1500)]
    items = [(1, " ".join(word() for _ in range(12))), (1, " ".join(word() for _ in range(15))), (None, " ".join(word() for _ in range(9))), (7, " ".join(long_)), (7, " ".join(long_))]
    near = [w if i % 200 else "new" for i, w in enumerate(long_)]
    docs = [(1, "x " + items[0][1]), (1, "x " + items[0][1]), (2, items[1][1] + " y"), (None, items[2][1]), (None, "nothing of theirs"), (3, " ".join(["so", *near, "it"])), (3, "an other row of three")]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, item_id int")
    theirs = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("theirs"))
    began = time.perf_counter()
    got = sorted(((r.doc_id, r.item_id, r.start, r.n_words) for r in decontamination.leaks(df, theirs).collect()), key=repr)
    assert got == sorted([(1, 1, 1, 12), (2, 1, 0, 15), (None, None, 0, 9), (3, 7, 1, 1500)], key=repr)
    assert time.perf_counter() - began < 60
    kept = decontamination.without_leaks(df, theirs)
    assert kept.columns == df.columns and sorted(r.item_id for r in kept.collect()) == [4, 6]


def test_long_windows_have_the_same_fingerprint(spark):
    random.seed(12)
    rows = [(n, [random.getrandbits(64) - (1 << 63) for _ in range(n)]) for n in (1, 2, 3, 40, 41, 3000)]
    df = spark.createDataFrame(rows, "n int, h array<long>")
    got = {r.n: r.fp for r in df.selectExpr("n", f"{decontamination._simhash('h')} as fp").collect()}
    for n, hashes in rows:
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
        assert got[n] % (1 << 64) == want
