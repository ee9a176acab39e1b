"""Feature ablation under cross validation, all subsets and rounds from one
pass of sums (M9).

A linear least-squares classifier on a set of columns needs nothing of the
examples but their sums of products.  One scan gives a matrix for each fold
(columns, a one, the label as +1 or -1); the training matrix of a round is the
sum of the other folds', every subset of columns is solved from it, and the
held-out squared error follows from the fold's own matrix.  A second scan
counts the decisions of all subsets at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.svm_newton import partition_groups, summed

RIDGE = 1e-6             # of the correlation matrix
REST = -1                # fold of the examples that only ever train
ROWS_PER_PRODUCT = 8_192


def _with_fold(examples: DataFrame) -> DataFrame:
    return examples.select(F.coalesce("fold", F.lit(REST)).cast("int").alias("fold"),
                           F.col("label").cast("int").alias("label"), "f")


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(fold, [features, 1, label]) of some thousand examples of a fold each."""
    for batch in batches:
        fold = batch.column(0).to_numpy(zero_copy_only=False)
        sign = np.where(batch.column(1).to_numpy(zero_copy_only=False) == 1, 1.0, -1.0)
        f = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(fold), dim)
        for i in np.unique(fold).tolist():
            mine = np.flatnonzero(fold == i)
            for at in range(0, len(mine), ROWS_PER_PRODUCT):
                rows = mine[at:at + ROWS_PER_PRODUCT]
                yield i, np.concatenate([f[rows], np.ones((len(rows), 1)), sign[rows, None]], axis=1)


def _records(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"model": pa.array(list(sums), pa.int32()),
                                       "sums": pa.array([s.tobytes() for s in sums.values()], pa.binary())})


def fold_moments(examples: DataFrame, dim: int) -> dict[int, np.ndarray]:
    """{fold: sums of products} of (fold, label, f), matrices of ``dim`` + 2
    rows; examples without a fold are in ``REST``.  The driver gets one matrix
    for each fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for i, a in _parts(batches, dim):
            sums[i] = sums.get(i, 0) + a.T @ a
        yield _records(sums)
    rows = _with_fold(examples)
    return {i: s.reshape(dim + 2, dim + 2) for i, s in summed(rows, run, partition_groups(rows)).items()}


def solve(moments: np.ndarray, columns: Sequence[int], ridge: float = RIDGE) -> np.ndarray:
    """Weights of all columns and the intercept (others 0) that fit the label by
    least squares on ``columns``, standardised, with a ridge; constant columns
    have no weight."""
    dim = len(moments) - 2
    out = np.zeros(dim + 1)
    n = moments[dim, dim]
    if n == 0:
        return out
    mean = moments[:, dim] / n
    cov = moments / n - np.outer(mean, mean)
    use = np.array([c for c in columns if cov[c, c] > 1e-12 * max(moments[c, c] / n, 1e-300)], int)
    if len(use):
        sd = np.sqrt(cov[use, use])
        corr = cov[np.ix_(use, use)] / np.outer(sd, sd)
        out[use] = np.linalg.solve(corr + ridge * np.eye(len(use)), cov[use, dim + 1] / sd) / sd
    out[dim] = mean[dim + 1] - out[:dim] @ mean[:dim]
    return out


def squared_error(moments: np.ndarray, weights: np.ndarray) -> float:
    """Mean squared error of ``weights`` on the examples of ``moments``."""
    dim = len(moments) - 2
    w = np.r_[weights, -1.0]
    return float(w @ moments @ w / moments[dim, dim])


def subsets_of(groups: dict[str, Sequence[int]], features: dict[str, int]) -> dict[str, list[int]]:
    """All joins of column groups, and all columns but one of ``features``."""
    names = list(groups)
    out = {}
    for bits in range(1, 1 << len(names)):
        chosen = [n for i, n in enumerate(names) if bits >> i & 1]
        out["+".join(chosen)] = sorted(c for n in chosen for c in groups[n])
    every = sorted(c for cs in groups.values() for c in cs)
    out.update({f"without {name}": [c for c in every if c != at] for name, at in features.items()})
    return out


def ablation(examples: DataFrame, dim: int, subsets: list[dict[str, list[int]]],
             ridge: float = RIDGE) -> DataFrame:
    """One row per subset and round: subset, fold, n, n_columns, mse, accuracy,
    precision, recall, f1 (held out).

    ``examples`` (fold, label, f) are read twice: pass a written table.
    ``subsets[i]`` names the columns of round ``i``.  A round whose fold has no
    examples gives no rows; a score without a denominator is 0."""
    moments = fold_moments(examples, dim)
    total = sum(moments.values())
    fitted = {i: {name: solve(total - moments[i], columns, ridge) for name, columns in named.items()}
              for i, named in enumerate(subsets) if i in moments}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacked = {i: np.stack(list(by_name.values()), axis=1) for i, by_name in fitted.items()}
        sums: dict[int, np.ndarray] = {}
        for i, a in _parts(batches, dim):
            if i in stacked:
                said, true = a[:, :-1] @ stacked[i] > 0, a[:, -1:] > 0
                sums[i] = sums.get(i, 0) + np.concatenate([
                    (said & true).sum(0), (said & ~true).sum(0), (~said & true).sum(0)]).astype(float)
        yield _records(sums)
    rows = _with_fold(examples)
    counted = summed(rows, run, partition_groups(rows))
    out = []
    for i, by_name in fitted.items():
        n = int(moments[i][dim, dim])
        tp, fp, fn = counted[i].reshape(3, len(by_name))
        for k, (name, w) in enumerate(by_name.items()):
            p, r = (float(tp[k] / d) if d else 0.0 for d in (tp[k] + fp[k], tp[k] + fn[k]))
            out.append((name, i, n, len(subsets[i][name]), squared_error(moments[i], w),
                        float(1 - (fp[k] + fn[k]) / n), p, r, 2 * p * r / (p + r) if p + r else 0.0))
    return examples.sparkSession.createDataFrame(
        out, "subset string, fold int, n long, n_columns int, mse double, accuracy double, precision double, "
             "recall double, f1 double")


def moments_table(spark, moments: dict[int, np.ndarray]) -> DataFrame:
    """(fold, i, j, n, mean): mean products of columns i <= j (the one and the
    label are the last two) for each fold."""
    rows = []
    for fold, m in moments.items():
        n = m[-2, -2]
        rows += [(fold, i, j, int(n), float(m[i, j] / n)) for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, "fold int, i int, j int, n long, mean double")
