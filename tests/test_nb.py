"""Naive Bayes over css token bags."""
import math

import pytest
from pyspark.sql import functions as F

from pagesift.operators import nb
from _helpers import pages_df


@pytest.fixture(scope="module")
def fitted(spark):
    df = pages_df(spark, [(1, [("a", {"content": 2}, 1), ("b", {"ad": 1, "nav": 1}, 0),
                               ("c", {"ad": 2}, 0)], "", "")])
    return df, nb.nb_fit(df)


def test_model_table(fitted):
    _, model = fitted
    t = {r["token"]: r for r in model.table.collect()}
    assert (t["content"]["pos_cnt"], t["content"]["neg_cnt"]) == (3, 1)
    assert (t["ad"]["pos_cnt"], t["ad"]["neg_cnt"]) == (1, 4)
    assert (t["nav"]["pos_cnt"], t["nav"]["neg_cnt"]) == (1, 2)
    assert t["content"]["pos_prob"] == pytest.approx(0.6)
    assert t["ad"]["neg_prob"] == pytest.approx(4 / 7)
    assert model.prior == pytest.approx(1 / 3)
    assert model.sparseness == pytest.approx(5 / 9)


@pytest.mark.parametrize("path", ["nested", "joined"])
def test_predict(spark, fitted, path):
    _, model = fitted
    probe = pages_df(spark, [(2, [("x", {"content": 1}, 0), ("y", {"ad": 1}, 0),
                                  ("z", {}, 0), ("w", {"unseen": 3}, 0)], "", "")])
    limit = nb.BROADCAST_BYTES if path == "nested" else 0
    blocks = nb.nb_predict(probe, model, broadcast_bytes=limit).first()["blocks"]
    got = [(round(b["nb_pos"], 6), round(b["nb_neg"], 6), b["prediction"]) for b in blocks]
    assert got[0] == (-1.609438, -2.351375, 1)
    assert got[1] == (-2.70805, -0.965081, 0)
    assert got[2] == (-1.098612, -0.405465, 0)
    assert got[3] == got[2]


def test_top_tokens(fitted):
    _, model = fitted
    wn = [r["token"] for r in nb.nb_weighted_negative(model, 2).orderBy("rank").collect()]
    assert wn == ["ad", "nav"]
    ind = nb.nb_indicative(model, 1).collect()
    kinds = {r["kind"]: r["token"] for r in ind}
    assert kinds == {"positive": "content", "negative": "ad"}
    assert nb.learned_tokens(model, 10) == ["ad", "nav", "content"]


def test_oov(spark, fitted):
    _, model = fitted
    probe = pages_df(spark, [(2, [("x", {"unseen": 1, "ad": 1}, 0)], "", "")])
    assert [r["token"] for r in nb.nb_oov(probe, model).collect()] == ["unseen"]


def test_zero_prior_is_minus_infinity():
    assert nb._ln(0.0) == float("-inf")
    assert nb._ln(0.5) == math.log(0.5)


def _many_tokens(spark, n=1500):
    blocks = [(f"b{i}", {f"t{i}": 1 + i % 3, f"t{(i * 7) % n}": 2}, i % 2) for i in range(n)]
    return pages_df(spark, [(1, blocks, "", ""), (1, blocks[:10], "", ""), (2, blocks[5:20], "", "")])


def test_large_vocabulary_copies_and_missing_labels(spark):
    """Scores are the same on both paths, for pages that share an id, and for
    pages without labels."""
    df = _many_tokens(spark)
    model = nb.nb_fit(df)
    assert model.n_tokens == 1500
    bare = df.withColumn("blocks", F.transform("blocks", lambda b: b.dropFields("label")))

    def scores(limit):
        rows = nb.nb_predict(bare, model, broadcast_bytes=limit).collect()
        return sorted((r["page_id"], len(r["blocks"]), [(round(b["nb_pos"], 9), round(b["nb_neg"], 9),
                                                         b["prediction"]) for b in r["blocks"]])
                      for r in rows)
    near, joined = scores(nb.BROADCAST_BYTES), scores(0)
    assert near == joined and [x[:2] for x in near] == [(1, 10), (1, 1500), (2, 15)]
    assert nb.nb_oov(bare, model).count() == 0


def test_fold_models_equal_separate_fits(spark):
    df = _many_tokens(spark, 60).withColumn("fold", F.when(F.col("page_id") == 1, 0).otherwise(1))
    for i, model in enumerate(nb.nb_fit_folds(df, 2)):
        alone = nb.nb_fit(df.where(F.col("fold") != i).drop("fold"))
        assert sorted(model.table.collect()) == sorted(alone.table.collect())
        assert (model.prior, model.n_blocks, model.n_tokens, model.nnz) == (
            alone.prior, alone.n_blocks, alone.n_tokens, alone.nnz)


def test_stream_of_a_table_folder(spark, tmp_path):
    from pagesift.streaming.scoring import page_stream, run_to_table, score_new_pages
    words = [f"w{i}" for i in range(1500)]
    df = pages_df(spark, [(1, [(w, {w: 1}, 1) for w in words] + [("x", {"ad": 1}, 0)] * 1500, "", "")])
    model = nb.nb_fit(df)
    rows = [(i, f"http://h/en/{i}", f"<body><p class='w{i}'>page {i} text</p><p class='ad'>ad</p></body>")
            for i in range(9)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(path)
    out = run_to_table(page_stream(spark, path, max_files=1), lambda b: score_new_pages(b, model))
    got = {r["page_id"]: r["extracted"] for r in spark.read.parquet(out).collect()}
    assert got == {i: f"page {i} text" for i in range(9)}


def test_oov_joins_counted_tokens(spark):
    # a frequent word reaches the join as one row, so no task gets all of its uses
    pages = pages_df(spark, [(i, [("t", {"a": 1, f"b{i % 2}": 2}, i % 2)], "", "") for i in range(6)])
    found = nb.nb_oov(pages, nb.nb_fit(pages.where("page_id % 2 = 0")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("Aggregate [token")
    assert [tuple(r) for r in found.collect()] == [("b1", 3)]


def test_fitted_and_scored_bags_hold_no_text(spark, sf_small, monkeypatch):
    """The queries of a model write bags and labels, not the pages' texts."""
    from pagesift.plans import queries as Q
    kept, written = Q.jobs.stored, []

    def stored(df, *name):
        written.append(df.schema)
        return kept(df, *name)
    monkeypatch.setattr(Q.jobs, "stored", stored)
    for name in ("nb_text_model", "nb_text_weighted_negative", "nb_text_indicative", "indicative_text_features"):
        Q.QUERIES[name](spark, sf_small).count()
    assert len(written) == 4
    for schema in written:
        assert schema.names == ["page_id", "blocks"]
        assert schema["blocks"].dataType.elementType.names == ["pos", "css", "label"]


def test_report_writes_bags_and_one_page(spark, tmp_path, monkeypatch):
    """the report's model is fitted on bags; only the page whose article is
    shown is written with its texts, picked by the scans (a null id is the first)."""
    from pagesift.plans import queries as Q
    gold = " ".join(f"g{i}" for i in range(9))
    rows = [(i if i != 7 else None, f"http://h/en/{i}",
             f"<body><p>{gold}</p><p>advert number {i} of many</p></body>") for i in range(5, 9)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(
        str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, gold) for i in range(4, 9)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    kept, written = Q.jobs.stored, []

    def stored(df, *name):
        out = kept(df, *name)
        written.append((out.schema["blocks"].dataType.elementType.names, out.count()))
        return out
    monkeypatch.setattr(Q.jobs, "stored", stored)
    got = {r["section"]: r for r in Q.QUERIES["nb_text_report"](spark, str(tmp_path)).collect()}
    assert [n for fields, n in written if "text" in fields] == [1]
    assert [n for fields, n in written if "text" not in fields] == [4]
    assert got["n_tokens"]["value"] == 9 + 4 + 4  # gold, four numbers, four words about them
    assert (got["article"]["value"], got["article"]["text"]) == (None, gold)
    one = Q._text_pages(spark, str(tmp_path), only=(8, 8))
    assert [(r["page_id"], r["doc_id"]) for r in one.collect()] == [(8, 8)]
    assert "EqualTo(doc_id,8)" in one._jdf.queryExecution().executedPlan().toString()


def test_a_model_cut_to_the_tokens_of_a_page_scores_it_alike(spark):
    df = _many_tokens(spark, 300)
    model, page = nb.nb_fit(df), df.where("page_id = 2")
    cut = nb.for_tokens_of(page, model)
    assert cut.table.count() == len({t for b in page.first()["blocks"] for t in b["css"]}) < model.n_tokens
    assert nb.nb_predict(page, cut).collect() == nb.nb_predict(page, model).collect()


def test_report_of_no_pages(spark, tmp_path):
    from pagesift.plans.queries import QUERIES
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["section"], r["value"]) for r in QUERIES["nb_text_report"](spark, str(tmp_path)).collect()] == [("n_tokens", 0.0)]
