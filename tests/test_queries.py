"""Registered queries against their DuckDB oracles on the smallest scale."""
import hashlib
import json

import pytest

import __spark_entry__ as entry_mod

duckdb = pytest.importorskip("duckdb")

FAST = ["load_pairs", "segment_blocks", "block_labels", "block_features", "css_tokens",
        "extract_article", "eval_tokens", "eval_report", "nb_model", "nb_predict",
        "scaled_features", "libsvm_lines", "score_curve", "score_summary", "kfold_assign",
        "holdout_split", "diagnostics", "feature_vectors", "stream_extract",
        "svm_saved", "block_table", "observed_diagnostics", "stream_eval", "stream_curve", "stream_pairs"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in ["pages", "documents", "part", "customer"]:
        c.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return c


def _canon(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for r in pdf.itertuples(index=False):
        vals = []
        for v in r:
            if v is None or (isinstance(v, float) and v != v) or str(v) == "<NA>":
                vals.append(None)
            elif isinstance(v, float) and v.is_integer():
                vals.append(int(v))
            else:
                vals.append(v.item() if hasattr(v, "item") else v)
        rows.append(json.dumps(vals, default=str))
    return list(pdf.columns), hashlib.md5("\n".join(sorted(rows)).encode()).hexdigest()


def test_every_oracle_key_is_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["page_id", "precision", "recall", "f1"]
    assert df.count() == 50


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, sf_small, con, name):
    spark_pdf = entry_mod.queries()[name](spark, sf_small).toPandas()
    oracle_pdf = con.sql(entry_mod.oracle_sql()[name]).df()
    assert len(spark_pdf) == len(oracle_pdf)
    assert _canon(spark_pdf) == _canon(oracle_pdf)


def test_materialized_pages_give_same_metrics(spark, sf_small, tmp_path):
    from pagesift.plans import jobs
    from pagesift.operators.evaluate import eval_tokens
    pages = jobs.labelled_pages(spark, sf_small)
    stored = jobs.materialize_pages(pages, str(tmp_path / "pages"))
    a = sorted(eval_tokens(jobs.gold_article(pages)).collect())
    b = sorted(eval_tokens(jobs.gold_article(stored)).collect())
    assert a == b
