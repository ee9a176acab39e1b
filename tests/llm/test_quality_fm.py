"""Factorisation machine: the identity, training and held-out accuracy."""
import zlib

import numpy as np
import pytest

from pagesift.llm import quality_fm as Q
from conftest import LONG, ODD


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(2)
    model = Q.Model(0.3, rng.normal(size=Q.SIZE), rng.normal(size=(Q.SIZE, Q.RANK)))
    texts = [(t or "").encode() for _, t in ODD[:8]] + [b"one two THREE | x### 12"]
    ends, place, value = Q.features(texts)
    got, _ = Q.margins(model, ends, place, value)
    start = 0
    for k, end in enumerate(ends):
        p, x = place[start:end], value[start:end]
        want = model.bias + model.weights[p] @ x
        if len(p) < 400:
            want += sum(model.vectors[p[i]] @ model.vectors[p[j]] * x[i] * x[j]
                        for i in range(len(p)) for j in range(i + 1, len(p)))
            assert got[k] == pytest.approx(want)
        start = end


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [(t or "").encode() for _, t in ODD] + [LONG.encode()]
    ends, place, value = Q.features(texts)
    start = 0
    for t, end in zip(texts, ends):
        e, p, x = Q.features([t])
        assert (p == place[start:end]).all() and np.allclose(x, value[start:end]) and e[0] == end - start
        start = end


def test_fold_and_held_out_accuracy(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.01")
    rows = Q.op6_quality_classifier(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    good = np.array([r["score"] for r in held if quality[r["doc_id"]] == 1])
    bad = np.array([r["score"] for r in held if quality[r["doc_id"]] == 0])
    assert np.mean(good[:, None] > bad[None]) > 0.98
    assert np.mean(good >= 0.7) > 0.95 and np.mean(bad >= 0.7) < 0.2


def test_labels_lang_source_and_id_are_no_inputs(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = docs_of([(i, "good prose, here." if i % 2 else "BAD!! x###", f"s{i % 2}") for i in range(200)])
    score = Q.scorer(spark, Q.train(docs, labels))
    other = docs_of([(i + 1, "good prose, here." if i % 2 else "BAD!! x###", "other") for i in range(200)])
    a = docs.select(score(docs["text"])).distinct().collect()
    b = other.select(score(other["text"])).distinct().collect()
    assert sorted(a) == sorted(b) and len(a) == 2


def test_odd_rows_and_empty_tables(spark, docs_of, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (4, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = Q.score_quality(odd_docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    none = Q.score_quality(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {1.0}
    assert Q.keep_quality(odd_docs, labels.limit(0)).columns == odd_docs.columns
    assert Q.score_quality(docs_of([]), labels).count() == 0
