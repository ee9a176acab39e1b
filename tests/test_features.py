"""Shallow-text features, relative position, scaler, de-duplication, libsvm."""
import pytest
from pyspark.sql import functions as F

from pagesift.operators.features import (SHALLOW_TEXT_FEATURES, block_features,
                                         feature_vectors, relative_position,
                                         training_examples, unique_examples, label_stats)
from pagesift.operators.scale import scale, scaler_fit
from pagesift.sources.sinks import libsvm_lines
from _helpers import pages_df

BLOCKS = ["alpha <<LINK<<beta gamma>>LINK>> delta", "One, two three. Four five six!",
          "single", "word " * 599 + "end"]
EXPECTED = [
    [3, 3, 3, 0.333333, 1, 1, 1],
    [5, 1.666667, 5, 0, 1.666667, 0.555556, 1.666667],
    [1, 1, 1, 0, 0.2, 0.6, 0.2],
    [500, 50, 16.189189, 0, 500, 50, 16.189189],
]


def test_shallow_text_features(spark):
    df = pages_df(spark, [(1, [(t, {}, 0) for t in BLOCKS], "", "")])
    blocks = block_features(df).first()["blocks"]
    for b, want in zip(blocks, EXPECTED):
        got = [round(b[c], 6) for c in SHALLOW_TEXT_FEATURES]
        assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("n,want", [
    (1, [5]), (2, [3, 5]), (3, [2, 4, 5]), (5, [1, 2, 3, 4, 5]),
    (7, [1, 2, 3, 3, 4, 5, 5]), (10, [1, 1, 2, 2, 3, 3, 4, 4, 5, 5])])
def test_relative_position(spark, n, want):
    df = pages_df(spark, [(1, [("x", {}, 0)] * n, "", "")])
    got = [b["rel_pos"] for b in relative_position(df).first()["blocks"]]
    assert got == [float(w) for w in want]


def test_feature_vector_order_and_padding(spark):
    df = pages_df(spark, [(1, [("a b c d", {"ad": 1}, 1), ("e", {}, 0)], "", "")])
    spec = ("relative_position", ("indicative_tokens", 3))
    rows = training_examples(feature_vectors(df, spec, ["ad"])).orderBy("pos").collect()
    assert [r["f"] for r in rows] == [[3.0, 1.0, 0.0, 0.0], [5.0, 0.0, 0.0, 0.0]]


def test_empty_spec_rejected(spark):
    df = pages_df(spark, [(1, [("a", {}, 0)], "", "")])
    with pytest.raises(ValueError):
        feature_vectors(df, ())


def test_scaler(spark):
    ex = spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],), ([5.0, 2.0],)], "f array<double>")
    model = scaler_fit(ex, 2)
    got = [r["f"] for r in scale(ex, model).collect()]
    assert sorted(got) == [[0.0, 2.0], [0.5, 2.0], [1.0, 2.0]]
    fitted = scaler_fit(spark.createDataFrame([([1.0],), ([5.0],)], "f array<double>"), 1)
    new = spark.createDataFrame([([9.0],)], "f array<double>")
    assert scale(new, fitted).first()["f"] == [2.0]


def test_scaler_negative_column_uses_max_abs(spark):
    ex = spark.createDataFrame([([-2.0],), ([1.0],)], "f array<double>")
    got = sorted(r["f"][0] for r in scale(ex, scaler_fit(ex, 1)).collect())
    assert got == [-1.0, 0.5]


def test_unique_examples_and_stats(spark):
    ex = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (0, [1.0, 2.0])],
                               "label int, f array<double>")
    assert unique_examples(ex).count() == 2
    s = label_stats(ex).first()
    assert (s["n_examples"], s["n_positive"]) == (3, 2)


def test_libsvm_line(spark):
    df = spark.createDataFrame([(1, [0.5, 0.0, 1.0])], "label int, f array<double>")
    assert libsvm_lines(df).first()["line"] == "1 1:0.500000 2:0.000000 3:1.000000"


def test_libsvm_exact_tie_rounds_half_even(spark):
    df = spark.createDataFrame([(0, [0.0078125])], "label int, f array<double>")
    assert libsvm_lines(df).first()["line"] == "0 1:%f" % 0.0078125
