"""Block classifier: RBF kernel approximated by seeded random Fourier
features, then linear SVMs on them (M1/M2).

Spark has no kernel SVM.  ``z(x) = sqrt(2/D) cos(W x + b)`` with
``W ~ N(0, 2 gamma)`` and ``b ~ U(0, 2 pi)`` makes ``z(x).z(y)`` approximate
``exp(-gamma |x - y|^2)`` (Rahimi & Recht, 2007); a linear SVM on ``z`` then
approximates the kernel SVM.  ``gamma`` defaults to ``1 / n_features``, the
classic default of RBF SVMs, and the penalty ``1 / (C n)`` matches the
``C``-weighted hinge objective with ``C = 1``.

``svm_fit_folds`` trains the models of all rounds of a cross validation
together (``svm_newton``): the example table holds raw features, which a pass
scales and maps as it reads them, so nothing wide is stored or cached.
Prediction scores a whole page per UDF call from its nested feature arrays, so
no per-block rows are shuffled back into pages; the model it needs is bounded
(D x d weights, D + 1 coefficients).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.operators.scale import ScalerModel
from pagesift.operators.svm_newton import fit_all, ranges
from pagesift.sources.tables import stored

DEFAULT_COMPONENTS = 128
DEFAULT_SEED = 42
# Blocks whose Fourier features are held at once while predicting.
ROWS_PER_PRODUCT = 8_192

@dataclass
class FourierMap:
    weights: np.ndarray   # D x d
    offsets: np.ndarray   # D

    @classmethod
    def draw(cls, dim: int, components: int = DEFAULT_COMPONENTS,
             gamma: float | None = None, seed: int = DEFAULT_SEED) -> "FourierMap":
        gamma = gamma if gamma is not None else 1.0 / max(dim, 1)
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(components, dim))
        b = rng.uniform(0.0, 2.0 * np.pi, size=components)
        return cls(w, b)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T  # the one wide matrix that is made
        z += self.offsets
        np.cos(z, out=z)
        z *= np.sqrt(2.0 / len(self.weights))
        return z


def scaler_arrays(scaler: ScalerModel) -> tuple[np.ndarray, np.ndarray]:
    """What to subtract from features, and what to divide them by."""
    rngs, nonneg = np.asarray(scaler.rng), np.asarray(scaler.non_negative)
    maxabs = np.asarray(scaler.max_abs)
    div = np.where(nonneg, np.where(rngs > 0, rngs, 1.0), np.where(maxabs > 0, maxabs, 1.0))
    return np.where(nonneg & (rngs > 0), np.asarray(scaler.minimum), 0.0), div


@dataclass
class ScaledMap:
    """Scaling, then the Fourier map, of a matrix of raw features."""
    sub: np.ndarray
    div: np.ndarray
    fourier: FourierMap

    @property
    def width(self) -> int:
        return len(self.fourier.weights)

    @property
    def key(self) -> bytes:
        return self.sub.tobytes() + self.div.tobytes()

    def __call__(self, f: np.ndarray) -> np.ndarray:
        return self.fourier((f - self.sub) / self.div)


@dataclass
class SVMModel:
    scaler: ScalerModel
    fourier: FourierMap
    coefficients: np.ndarray
    intercept: float
    iterations: int = 0
    converged: bool = True

    def mapped(self) -> ScaledMap:
        return ScaledMap(*scaler_arrays(self.scaler), self.fourier)

    def page_udf(self, out_type=T.ArrayType(T.IntegerType())):
        """Arrow UDF: a page's ``ARRAY<ARRAY<DOUBLE>>`` raw features -> 0/1
        per block (scale, map, linear decision ``margin > 0``)."""
        decide = fold_udf([self], out_type)
        return lambda pages: decide(pages, F.lit(0))


def fold_udf(models: list[SVMModel], out_type=T.ArrayType(T.IntegerType())):
    """``page_udf`` of a model for each fold: takes the page's features and its
    fold; pages without a model (fold NULL) get NULL."""
    maps = [m.mapped() for m in models]
    weights = [(m.coefficients, m.intercept) for m in models]
    dim = models[0].fourier.weights.shape[1]

    @F.arrow_udf(out_type)
    def predict(pages: pa.Array, folds: pa.Array) -> pa.Array:
        # all blocks of the batch at once; page boundaries from the offsets
        blocks = pages.flatten()
        x = blocks.flatten().to_numpy(zero_copy_only=False).reshape(len(blocks), dim)
        sizes = pages.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fold = folds.fill_null(-1).to_numpy(zero_copy_only=False)
        of = np.repeat(fold, sizes)
        decision = np.zeros(len(x), np.int32)
        for i in np.unique(of).tolist():
            mine = np.flatnonzero(of == i)
            # a page may have any number of blocks: fixed-size products
            for at in range(0, len(mine) if 0 <= i < len(maps) else 0, ROWS_PER_PRODUCT):
                rows = mine[at:at + ROWS_PER_PRODUCT]
                decision[rows] = maps[i](x[rows]) @ weights[i][0] + weights[i][1] > 0
        none = (fold < 0) | (fold >= len(maps)) | pages.is_null().to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[none, False]) if none.any() else pa.array(offsets),
                                        pa.array(decision, pa.int32()))
    return predict


def fold_weights(k: int, fold: str = "fold") -> Column:
    """Weights of a row in the models of ``k`` rounds: how many of a group's
    rows are not in the round's fold (rows without a fold train in all)."""
    return F.array(*[F.count_if(F.col(fold).isNull() | (F.col(fold) != i)).cast("double") for i in range(k)])


def stored_examples(folded: DataFrame) -> DataFrame:
    """Examples with weights, written for a fit: in as many parts as tasks can
    run, as every pass computes on them."""
    spark = folded.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return stored(folded.repartition(parts), "examples")


def svm_fit_folds(examples: DataFrame, dim: int, k: int, components: int = DEFAULT_COMPONENTS,
                  c: float = 1.0, seed: int = DEFAULT_SEED) -> list[SVMModel]:
    """M5/M6: ``k`` models in one fit, on (label, f, w ARRAY<DOUBLE>): ``w[i]``
    is the row's weight for model ``i``, 0 if it does not train it.  Every model
    has its own scaler.  ``examples`` is read once a pass: pass a written table."""
    scalers = []
    for low, high, far in ranges(examples, dim, k):
        low, high, far = (np.nan_to_num(v, nan=0.0).tolist() for v in (low, high, far))
        scalers.append(ScalerModel([v >= 0 for v in low], low, [b - a for a, b in zip(low, high)], far))
    fourier = FourierMap.draw(dim, components, seed=seed)
    fits = fit_all(examples, [ScaledMap(*scaler_arrays(s), fourier) for s in scalers], dim, c)
    return [SVMModel(s, fourier, f.coefficients, f.intercept, f.passes, f.converged)
            for s, f in zip(scalers, fits)]


def svm_fit(examples: DataFrame, dim: int, components: int = DEFAULT_COMPONENTS,
            c: float = 1.0, seed: int = DEFAULT_SEED) -> SVMModel:
    """M1: scaler, random Fourier map and linear SVM on ``(label, f)``.  Equal
    examples are folded into one with their number before the fit.  The model
    tells the passes over the data and whether it got to its tolerance."""
    folded = examples.groupBy("label", "f").agg(F.array(F.count("*").cast("double")).alias("w"))
    return svm_fit_folds(stored_examples(folded), dim, 1, components, c, seed)[0]


def svm_predict_blocks(df: DataFrame, model: SVMModel, out: str = "prediction") -> DataFrame:
    """M2: add ``out`` to every block of pages carrying ``blocks[].f``.  A
    generator of one row keeps the features in a projection below the UDF, so a
    filter on what comes of it can't be pushed through."""
    return _with_decisions(df, lambda f: model.page_udf()(f), out)


def svm_predict_folds(df: DataFrame, models: list[SVMModel], fold: str = "fold",
                      out: str = "prediction") -> DataFrame:
    """M5: as ``svm_predict_blocks``, each page by the model of its fold."""
    return _with_decisions(df, lambda f: fold_udf(models)(f, F.col(fold)), out)


def _with_decisions(df: DataFrame, decide, out: str) -> DataFrame:
    held = df.select("*", F.explode(F.array(F.transform("blocks", lambda b: b["f"]))).alias("_f"))
    return held.withColumn("_svm", decide(F.col("_f"))).drop("_f").withColumn("blocks", F.transform(
        "blocks", lambda b, i: b.withField(out, F.get(F.col("_svm"), i)))).drop("_svm")
