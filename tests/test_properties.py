"""Property checks from the test strategy: nested = window features, scaler
range on its own training data, marker round trip."""
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagesift.functions.text import mark_anchor, remove_markers, strip
from pagesift.operators.features import (SHALLOW_TEXT, SHALLOW_TEXT_FEATURES, block_features,
                                         block_features_window, feature_vectors,
                                         training_examples)
from pagesift.operators.scale import scale, scaler_fit
from pagesift.operators.segment import explode_blocks
from pagesift.plans import jobs


def test_nested_equals_window_features(spark, sf_small):
    pages = jobs.labelled_pages(spark, sf_small).persist()
    nested = explode_blocks(block_features(pages)).select("page_id", "pos", *SHALLOW_TEXT_FEATURES)
    window = block_features_window(explode_blocks(pages).select("page_id", "pos", "text")) \
        .select("page_id", "pos", *SHALLOW_TEXT_FEATURES)
    assert nested.count() == window.count()
    assert nested.exceptAll(window).count() == 0


def test_scaled_training_data_in_unit_range(spark, sf_small):
    pages = jobs.labelled_pages(spark, sf_small)
    ex = training_examples(feature_vectors(pages, (SHALLOW_TEXT, "relative_position"))).persist()
    out = scale(ex, scaler_fit(ex, 8)).select(F.explode("f").alias("x"))
    lo, hi = out.agg(F.min("x"), F.max("x")).first()
    assert 0.0 <= lo and hi <= 1.0


_TEXT = st.text(alphabet=st.sampled_from(list("ab <>\t\n 　.")), max_size=20)


@settings(max_examples=60, deadline=None)
@given(_TEXT)
def test_marker_round_trip(spark, s):
    row = spark.createDataFrame([(s,)], "s string").select(
        remove_markers(mark_anchor("s")).alias("a"), strip("s").alias("b")).first()
    assert row["a"] == row["b"] == s.strip()
