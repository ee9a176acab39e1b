"""Plan shape of registered queries: pruning, pushdown, no cartesian joins."""
import pytest

from pagesift.plans.queries import QUERIES

LIGHT = ["segment_blocks", "block_features", "eval_tokens", "nb_predict", "score_curve",
         "kfold_assign", "css_tokens", "extract_article", "feature_vectors"]


def _plan(df):
    # the physical plan before adaptive execution wraps it (no initial/final copies)
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_cartesian_products(spark, sf_small, name):
    plan = _plan(QUERIES[name](spark, sf_small))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pages_scan_prunes_columns(spark, sf_small):
    plan = _plan(QUERIES["kfold_assign"](spark, sf_small))
    assert "ReadSchema: struct<page_id:bigint>" in plan or "struct<page_id:bigint>" in plan


def test_documents_scan_reads_two_columns(spark, sf_small):
    df = QUERIES["segment_blocks"](spark, sf_small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "struct<doc_id:bigint,text:string>" in plan
    assert "lang" not in plan


def test_segmentation_udf_once_per_page(spark, sf_small):
    # cached relations print the plan they cache; start from a clean cache
    spark.catalog.clearCache()
    plan = _plan(QUERIES["block_features"](spark, sf_small))
    assert plan.count("ArrowEvalPython") == 1
