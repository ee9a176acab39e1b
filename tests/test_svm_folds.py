"""The joint fit of all rounds against fits one by one, brute force and MLlib."""
import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pagesift.operators import svm as V
from pagesift.operators import svm_newton as N
from pagesift.operators.features import SHALLOW_TEXT, feature_vectors, training_examples
from pagesift.operators.scale import scaler_fit
from pagesift.operators.split import stratified_folds
from pagesift.plans import jobs


@pytest.fixture(scope="module")
def blocks(spark, sf_small):
    rows = training_examples(feature_vectors(jobs.labelled_pages(spark, sf_small), (SHALLOW_TEXT,)))
    return jobs.stored(stratified_folds(jobs.stored(rows), 4))


def objective(model, x, y, n=None):
    w, b = model.coefficients, model.intercept
    margin = np.where(y == 1, 1, -1) * (model.mapped()(x) @ w + b)
    return np.maximum(0, 1 - margin).mean() + (w @ w) / (2 * len(y))


def arrays(df):
    t = df.select("label", "f").toArrow()
    return np.array(t["f"].combine_chunks().flatten()).reshape(len(t), -1), np.array(t["label"])


def test_joint_fit_equals_fits_one_by_one(blocks):
    folded = blocks.groupBy("label", "f").agg(V.fold_weights(4).alias("w"))
    joint = V.svm_fit_folds(V.stored_examples(folded), 7, 4)
    for i, model in enumerate(joint):
        train, test = blocks.where(F.col("fold") != i), blocks.where(F.col("fold") == i)
        alone = V.svm_fit(train, 7)
        want = scaler_fit(train, 7)
        assert model.converged and alone.converged
        assert np.allclose(model.scaler.minimum, want.minimum) and np.allclose(model.scaler.rng, want.rng)
        assert model.scaler.non_negative == want.non_negative and np.allclose(model.scaler.max_abs, want.max_abs)
        x, y = arrays(test)
        a = model.mapped()(x) @ model.coefficients + model.intercept > 0
        b = alone.mapped()(x) @ alone.coefficients + alone.intercept > 0
        assert abs((a == y).mean() - (b == y).mean()) <= 1e-3
        x, y = arrays(train)
        assert objective(model, x, y) == pytest.approx(objective(alone, x, y), abs=1e-5)


def test_objective_is_not_above_that_of_another_solver(blocks):
    model = V.svm_fit(blocks, 7)
    x, y = arrays(blocks)
    z = model.mapped()(x)
    rows = [(float(label), row.tolist()) for label, row in zip(y, z)]
    frame = blocks.sparkSession.createDataFrame(rows, "label double, z array<double>").select(
        "label", array_to_vector("z").alias("features"))
    other = LinearSVC(maxIter=60, tol=1e-6, regParam=1.0 / len(y), standardization=False).fit(frame)
    theirs = V.SVMModel(model.scaler, model.fourier, other.coefficients.toArray(), other.intercept)
    assert objective(model, x, y) <= objective(theirs, x, y) + 1e-4


def test_predictions_by_fold(spark, blocks):
    folded = V.stored_examples(blocks.groupBy("label", "f").agg(V.fold_weights(4).alias("w")))
    models = V.svm_fit_folds(folded, 7, 4)
    pages = blocks.where("page_id < 6").groupBy("page_id").agg(
        F.collect_list(F.struct("pos", "label", "f")).alias("blocks")).withColumn(
        "fold", F.when(F.col("page_id") == 3, F.lit(None)).otherwise((F.col("page_id") % 4).cast("int")))
    got = {r["page_id"]: r for r in V.svm_predict_folds(jobs.stored(pages), models).collect()}
    for r in got.values():
        for b in r["blocks"]:
            if r["fold"] is None:
                assert b["prediction"] is None
                continue
            m = models[r["fold"]]
            want = m.mapped()(np.array([b["f"]])) @ m.coefficients + m.intercept > 0
            assert b["prediction"] == int(want[0])


def test_block_cv_like_separate_fits(spark, sf_small):
    pages = jobs.stored(jobs.labelled_pages(spark, sf_small))
    got = {r["fold"]: r["accuracy"] for r in jobs.block_cv(pages, 3).collect()}
    examples = stratified_folds(jobs.stored(training_examples(feature_vectors(pages, (SHALLOW_TEXT,)))), 3)
    for i in range(3):
        m = V.svm_fit(examples.where(F.col("fold") != i), 7)
        x, y = arrays(examples.where(F.col("fold") == i))
        assert got[i] == pytest.approx(((m.mapped()(x) @ m.coefficients + m.intercept > 0) == y).mean(), abs=1e-3)


def test_merging_in_groups_and_models_without_examples(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(a + b > 0), [float(a), float(b)], [1.0, 0.0]) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "label int, f array<double>, w array<double>").repartition(6)
    one = V.svm_fit_folds(df, 2, 2)
    monkeypatch.setattr(N, "MERGED", 2)
    again = V.svm_fit_folds(df, 2, 2)
    assert np.allclose(one[0].coefficients, again[0].coefficients, atol=1e-5)
    assert not one[1].coefficients.any() and one[1].intercept == 0
    x, y = arrays(df)
    assert ((one[0].mapped()(x) @ one[0].coefficients + one[0].intercept > 0) == y).mean() > 0.95


def test_rounded_hinge_has_this_derivative():
    m = np.linspace(-2, 3, 501)
    for h in (2.0, 0.5, 0.02):
        loss, slope, _ = N.rounded_hinge(m, h)
        up, down = N.rounded_hinge(m + 1e-6, h)[0], N.rounded_hinge(m - 1e-6, h)[0]
        assert np.allclose((up - down) / 2e-6, slope, atol=1e-4)
        assert np.abs(loss - np.maximum(0, 1 - m)).max() <= h / 4 + 1e-12


def test_squares_of_all_models_are_those_of_each(monkeypatch):
    """rows that models share are multiplied once, not once for each model."""
    rng = np.random.default_rng(4)
    z, base = rng.normal(size=(900, 6)), rng.integers(0, 5, 900) * rng.random(900)
    weights = np.repeat(base[:, None], 10, axis=1)
    fold = rng.integers(0, 10, 900)
    weights[np.arange(900), fold] = 0.0
    weights[:30] = rng.random((30, 10))
    whole, taken = N._square, []
    monkeypatch.setattr(N, "_square", lambda z, w: taken.append((w > 0).sum()) or whole(z, w))
    for columns in (range(10), [3], [3, 8], []):
        found = N.weighted_squares(z, weights[:, list(columns)]) if columns else []
        for i, got in zip(columns, found, strict=True):
            assert np.allclose(got, (z * weights[:, [i]]).T @ z)
        if len(columns) == 10:
            assert sum(taken) < 3 * 900


def test_small_batches_are_gathered():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n, dim, k = 2 * N.ROWS_PER_PRODUCT + 7, 3, 2
    f, w, label = rng.random((n, dim)), rng.random((n, k)), rng.integers(0, 2, n).astype(np.int32)
    batches = [pa.RecordBatch.from_pydict({"label": pa.array(label[a:a + 100]), "f": pa.array(f[a:a + 100].tolist()),
                                           "w": pa.array(w[a:a + 100].tolist())}) for a in range(0, n, 100)]
    got = list(N._rows(iter(batches[:0] + [batches[0].slice(0, 0)] + batches), dim, k))
    assert max(len(x[0]) for x in got) == N.ROWS_PER_PRODUCT and len(got) < len(batches) / 4
    assert np.array_equal(np.concatenate([x[0] for x in got]), f)
    assert np.array_equal(np.concatenate([x[2] for x in got]), w)
    assert np.array_equal(np.concatenate([x[1] for x in got]), np.where(label == 1, 1.0, -1.0))
