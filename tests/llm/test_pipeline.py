"""The pipeline on a small corpus: each stage against brute force on what its predecessor kept."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_near_text import shingles
from test_simhash_components import union_find
from test_text_stages import plain_leaks
from tokenizers import Tokenizer

from loomwork.llm import suffix_dedup


def corpus():
    random.seed(21)
    words = "the of and to in was for with that this".split()
    prose = lambda n: " ".join(random.choice(words) if random.random() < 0.5 else "".join(random.choice("lmnoprst") for _ in range(5)) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate((20, 35, 50))] + [(9, None)]
    passage = prose(70)
    docs = [prose(90) for _ in range(220)]
    docs += [docs[3], docs[3].replace(" ", "\n"), docs[4] + " one more", prose(40) + " " + passage + " " + prose(40), prose(30) + " " + passage, f"{prose(30)} {items[1][1]} {prose(30)}", "%% ".join(f"q{random.random()}" for _ in range(80))]
    rows = [(i, t, "en", "s", len(t), i * 2) for i, t in enumerate(docs)]
    rows += [(None, f"{prose(20)} {items[2][1]}", "en", None, 1, 1), (None, prose(60), None, None, None, None), (900, None, None, "s", 0, 0), (901, "", "xx", "s", 0, 0), (902, docs[7], "en", "s", 1, 1), (902, docs[7], "en", "s", 1, 1)]
    return rows, [(i, 1, 0) for i in range(0, 220)] + [(None, None, None)], items


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long"
    for name, data, kind in (("documents", rows, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, kind).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    sf_dir = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns, name
        path = f"{tmp_path}/out{k}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = (before.collect(), docs.collect())

    before, after = kept["quality_classifier"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {226}  # the junk, and no clean text

    before, after = kept["simhash_near_dedup"]
    known = [r for r in before if r.doc_id is not None]
    own = [shingles(r.text) for r in known]
    near = [(i, j) for i in range(len(own)) for j in range(i) if own[i] == own[j] or len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    group = union_find(range(len(own)), near)
    least = {}
    for i, top in group.items():
        least[top] = min(least.get(top, known[i].doc_id), known[i].doc_id)
    assert {r.doc_id for r in after if r.doc_id is not None} == set(least.values())
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)

    before, after = kept["suffix_array_dedup"]
    order = sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    if sum(r.doc_id is None for r in order) == 1:  # without an id the order is that of a hash
        gone = suffix_dedup.brute_force([(r.text or "").encode() for r in order])
        want = {r.doc_id: bytes(c for c, g in zip((r.text or "").encode(), cut, strict=True) if not g).decode() for r, cut in zip(order, gone, strict=True)}
        assert {r.doc_id: r.text or "" for r in after} == want
    assert len(after) == len(before) and sum(len(r.text or "") for r in after) < sum(len(r.text or "") for r in before) - 300

    before, after = kept["benchmark_decontamination"]
    leaks = {i for i, _ in plain_leaks([(i, r.text) for i, r in enumerate(before)], items)}
    assert len(leaks) == 2 and sorted(((r.doc_id, r.text) for i, r in enumerate(before) if i not in leaks), key=repr) == sorted(((r.doc_id, r.text) for r in after), key=repr)

    before, after = kept["bpe_encoding"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in before))
    assert sorted(r.ids_sha256 for r in after) == want and all(len(r.ids) == 4 * r.n_tokens for r in after)


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0, name
