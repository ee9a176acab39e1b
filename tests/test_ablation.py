"""Subsets solved from sums of products against fits of their own."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.operators import ablation as A
from pagesift.plans import jobs
from pagesift.plans.queries import IND_SPEC


@pytest.fixture(scope="module")
def given(spark, sf_small):
    """The given pages' examples, over word bags, so that rounds learn tokens."""
    from pagesift.operators.nb import with_text_bags
    return jobs.ablation_examples(with_text_bags(jobs.labelled_pages(spark, sf_small)), 5, IND_SPEC)


def arrays(df):
    t = df.select("label", "f").toArrow()
    return np.array(t["f"].combine_chunks().flatten()).reshape(len(t), -1), np.where(np.array(t["label"]) == 1, 1.0, -1.0)


def single_fit(x, y, columns):
    """Ridge least squares on standardised columns, from the rows themselves."""
    columns = [c for c in columns if x[:, c].std() > 0]
    mean, sd = x[:, columns].mean(0), x[:, columns].std(0)
    z = (x[:, columns] - mean) / sd
    a = np.concatenate([z / np.sqrt(len(z)), np.sqrt(A.RIDGE) * np.eye(len(columns))])
    w = np.linalg.lstsq(a, np.r_[(y - y.mean()) / np.sqrt(len(z)), np.zeros(len(columns))], rcond=None)[0]
    return lambda t: ((t[:, columns] - mean) / sd) @ w + y.mean()


def test_every_subset_like_a_fit_of_its_own(given):
    examples, dim, subsets = given
    got = {(r["subset"], r["fold"]): r for r in A.ablation(examples, dim, subsets).collect()}
    assert len(got) == sum(len(s) for s in subsets) and len(subsets[0]) == 7 + 8
    for fold in range(5):
        x, y = arrays(examples.where(F.col("fold").isNull() | (F.col("fold") != fold)))
        tx, ty = arrays(examples.where(F.col("fold") == fold))
        for name in ("shallow_text", "relative_position", "indicative_tokens", "without link_density",
                     "shallow_text+relative_position+indicative_tokens"):
            r, columns = got[name, fold], subsets[fold][name]
            score = single_fit(x, y, columns)(tx)
            assert (r["n"], r["n_columns"]) == (len(ty), len(columns))
            assert r["mse"] == pytest.approx(((score - ty) ** 2).mean(), rel=1e-5)
            tp, fp, fn = (((score > 0) & (ty > 0)).sum(), ((score > 0) & (ty < 0)).sum(), ((score <= 0) & (ty > 0)).sum())
            assert r["accuracy"] == pytest.approx(((score > 0) == (ty > 0)).mean(), abs=2 / len(ty))
            assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0.0, abs=5e-3)


def test_more_columns_fit_the_training_rows_better(given):
    examples, dim, subsets = given
    moments = A.fold_moments(examples, dim)
    total = sum(moments.values())
    error = {n: A.squared_error(total, A.solve(total, c)) for n, c in subsets[0].items()}
    every = error["shallow_text+relative_position+indicative_tokens"]
    assert all(every <= e + 1e-6 for e in error.values())


def test_odd_examples(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 0, [1.0, 3.0]), (1, 1, [1.0, 1.0]), (None, 0, [1.0, 5.0]), (None, 0, [1.0, 4.0])]
    df = spark.createDataFrame(rows, "fold int, label int, f array<double>").repartition(3)
    m = A.fold_moments(df, 2)
    assert set(m) == {0, 1, A.REST} and m[A.REST][2, 2] == 2 and m[0][1, 1] == 13.0
    found = A.ablation(df, 2, [{"constant": [0], "both": [0, 1]}] * 3).collect()
    assert {(r["subset"], r["fold"]) for r in found} == {(s, f) for s in ("constant", "both") for f in (0, 1)}
    assert A.ablation(df.where("false"), 2, [{"both": [0, 1]}]).collect() == []
    table = {(r["fold"], r["i"], r["j"]): r["mean"] for r in A.moments_table(spark, m).collect()}
    assert table[0, 1, 1] == 6.5 and table[-1, 1, 3] == -4.5
