"""Filters and summaries on what predictors and evaluations return (their
Python stages must stay apart from what is pushed down), and the jobs on them."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagesift.operators.curve import score_curve, score_summary
from pagesift.operators.evaluate import eval_lcs, lcs_inclusion
from pagesift.operators.features import SHALLOW_TEXT, feature_vectors, training_examples
from pagesift.operators.nb import nb_fit, nb_predict
from pagesift.operators.scale import scaler_fit
from pagesift.operators.svm import FourierMap, SVMModel, svm_predict_blocks
from pagesift.plans import jobs
from pagesift.plans import queries as Q
import numpy as np


@pytest.fixture(scope="module")
def pages(spark, sf_small):
    return jobs.stored(jobs.labelled_pages(spark, sf_small))


@pytest.fixture(scope="module")
def predicted(pages):
    feats = feature_vectors(pages, (SHALLOW_TEXT,))
    svm = SVMModel(scaler_fit(training_examples(feats), 7),
                   FourierMap(np.array(Q.FIXED_MAP), np.array(Q.FIXED_OFFSETS)),
                   np.array(Q.FIXED_COEFFICIENTS), Q.FIXED_INTERCEPT)
    return {"svm": svm_predict_blocks(feats, svm), "nb": nb_predict(pages, nb_fit(pages))}


@pytest.mark.parametrize("kind", ["svm", "nb"])
@pytest.mark.parametrize("lcs", [False, True])
def test_filters_on_scores(predicted, kind, lcs):
    scored = jobs.score_pages(predicted[kind], lcs=lcs)
    rows = scored.collect()
    for c in ("f1", *(["lcs_f1"] if lcs else [])):
        high = sum(r[c] is not None and r[c] > 0.5 for r in rows)
        assert len(scored.where(f"{c} > 0.5").collect()) == high
        assert scored.where(f"{c} is not null").count() == sum(r[c] is not None for r in rows)
        assert score_summary(scored, c).first()["n"] == sum(r[c] is not None for r in rows)
        assert score_curve(scored, c).count() == len({r[c] for r in rows if r[c] is not None})


@pytest.mark.parametrize("kind", ["svm", "nb"])
def test_filters_on_blocks(predicted, kind):
    blocks = predicted[kind].select("page_id", F.inline("blocks")).select("page_id", "pos", "prediction")
    rows = blocks.collect()
    assert blocks.where("prediction = 1").count() == sum(r["prediction"] for r in rows)
    some = predicted[kind].where(F.exists("blocks", lambda b: b["prediction"] == 1))
    assert some.count() == len({r["page_id"] for r in rows if r["prediction"]})


def test_filters_on_lcs(pages):
    art = jobs.gold_article(pages)
    scored = eval_lcs(art)
    assert scored.where("lcs_f1 > 0.9").count() == sum((r["lcs_f1"] or 0) > 0.9 for r in scored.collect())
    flags = lcs_inclusion(art)
    column = next(c for c in flags.columns if c != "page_id")
    assert flags.where(F.col(column).isNotNull()).count() == sum(r[column] is not None for r in flags.collect())


def test_jobs_that_fit_an_svm(spark, sf_small):
    for name in ("resub_curve", "resub_eval", "svm_score", "cv_eval", "block_cv"):
        assert entry.queries()[name](spark, sf_small).count() > 0
