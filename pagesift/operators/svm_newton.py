"""Linear SVMs over Fourier features, all models of a cross validation in one
fit: every pass reads the examples once for all of them.

Each model minimises ``mean(hinge) + |w|^2 / (2 C n)`` over its own weighted
examples (the intercept is not penalised).  The hinge is rounded off within
``h`` of its corner, so Newton's method works; ``h`` falls in stages, each one
starting where the last ended, until the objective is that of the hinge to four
digits.  A pass evaluates loss, gradient and Hessian of all unfinished models
at their next points: every partition sums them into one matrix a model, what
models have in common once for all, and the partitions' matrices are summed by
groups before the driver gets one of them for each model.  Steps that do not
lower the loss are halved.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# h of each stage, and the gain of a step that ends it.  At the first all
# margins are on the round part; only the last one has to be solved well.
STAGES = ((2.0, 1e-2), (0.5, 1e-3), (0.1, 1e-5), (0.02, 1e-7))
MOST_PASSES = 500                # guards against a run that never ends, reported
ROWS_PER_PRODUCT = 1_024
MERGED = 32                      # partitions whose sums are merged in one task first


@dataclass
class Fitted:
    coefficients: np.ndarray
    intercept: float
    passes: int
    converged: bool


@dataclass
class _Run:
    """One model on its way: best point so far with its loss, gradient and
    Hessian, the direction and step that are tried."""
    point: np.ndarray
    stage: int = 0
    loss: float = float("inf")
    gradient: np.ndarray | None = None
    hessian: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 0.0
    done: bool = False
    trial: np.ndarray = field(init=False)

    def __post_init__(self):
        self.trial = self.point

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """What the pass found at ``trial``: go on from there, or halve the step."""
        gain = self.loss - loss
        if gain < 0 and self.step > 1e-6:
            self.step /= 2
        else:
            if gain >= 0:
                self.point, self.loss, self.gradient, self.hessian = self.trial, loss, gradient, hessian
            if gain < STAGES[self.stage][1]:
                self.stage += 1
                if self.stage == len(STAGES):
                    self.done = True
                    return
                # the loss is another one from here: look at the same point again
                self.loss, self.step, self.trial = float("inf"), 0.0, self.point
                return
            d = len(self.point)
            self.direction = -np.linalg.solve(self.hessian + 1e-10 * np.eye(d), self.gradient)
            self.step = 1.0
        self.trial = self.point + self.step * self.direction


def rounded_hinge(margin: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its derivative, and where it is curved (there by 1 / 2h)."""
    curved = np.abs(1 - margin) < h
    straight = margin <= 1 - h
    loss = np.where(straight, 1 - margin, np.where(curved, (1 + h - margin) ** 2 / (4 * h), 0.0))
    slope = np.where(straight, -1.0, np.where(curved, -(1 + h - margin) / (2 * h), 0.0))
    return loss, slope, curved


def _rows(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, +1 or -1, weights by model) of some thousand examples each,
    however small the batches are."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_PER_PRODUCT:
            yield from _cut(held, dim, k)
            held, n = [], 0
    if n:
        yield from _cut(held, dim, k)


def _cut(batches: list[pa.RecordBatch], dim: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    label = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
    f, w = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in batches])
            .reshape(len(label), width) for c, width in ((1, dim), (2, k)))
    for a in range(0, len(label), ROWS_PER_PRODUCT):
        part = slice(a, a + ROWS_PER_PRODUCT)
        yield f[part], np.where(label[part] == 1, 1.0, -1.0), w[part]


def summed(examples: DataFrame, run, groups: int, merge=np.add) -> dict[int, np.ndarray]:
    """{model: sums} of what ``run`` yields as (model, sums binary) in every
    partition, merged by ``groups`` of partitions first if there are several."""
    schema = "model int, sums binary"

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for raw in table["sums"].to_pylist():
            part = np.frombuffer(raw, np.float64)
            total = part if total is None else merge(total, part)
        return pa.table({"model": table["model"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    parts = examples.mapInArrow(run, schema)
    if groups > 1:
        parts = (parts.withColumn("part", F.spark_partition_id() % groups).groupBy("model", "part")
                 .applyInArrow(lambda key, t: merged(t.select(["model", "sums"])), schema)
                 .groupBy("model").applyInArrow(merged, schema))
    out: dict[int, np.ndarray] = {}
    found = parts.toArrow()  # MERGED rows a model at most
    for model, raw in zip(found["model"].to_pylist(), found["sums"]):
        part = np.frombuffer(raw.as_buffer(), np.float64)
        out[model] = merge(out[model], part) if model in out else part
    return out


def partition_groups(examples: DataFrame) -> int:
    return -(-examples.rdd.getNumPartitions() // MERGED)


def ranges(examples: DataFrame, dim: int, k: int) -> list[np.ndarray]:
    """For each model the rows (smallest, largest, largest absolute value) of
    every feature over its examples; nan without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.full((k, 2, dim), -np.inf)
        for f, _, w in _rows(batches, dim, k):
            for i in range(k):
                mine = f[w[:, i] > 0]
                if len(mine):
                    out[i] = np.maximum(out[i], [(-mine).max(0), mine.max(0)])
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(k), pa.int32()),
                                          "sums": pa.array([o.tobytes() for o in out], pa.binary())})
    examples = examples.select("label", "f", "w")
    found = summed(examples, run, partition_groups(examples), np.maximum)
    out = []
    for i in range(k):
        low, high = found[i].reshape(2, dim) if i in found else np.full((2, dim), -np.inf)
        low = -low
        out.append(np.where(low <= high, [low, high, np.maximum(np.abs(low), np.abs(high))], np.nan))
    return out


def fit_all(examples: DataFrame, maps: list, dim: int, c: float = 1.0) -> list[Fitted]:
    """One model for each of ``maps`` (functions of a feature matrix), on the
    examples (label, f, w) weighted by ``w[model]``.  Equal maps are computed
    once.  A model without examples decides 0."""
    k = len(maps)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(k), False
        for _, _, w in _rows(batches, dim, k):
            total += w.sum(0)
            any_ = True
        if any_:
            yield pa.RecordBatch.from_pydict({"model": pa.array([0], pa.int32()),
                                              "sums": pa.array([total.tobytes()], pa.binary())})
    examples = examples.select("label", "f", "w")
    merging = partition_groups(examples)
    n = summed(examples, weights, merging).get(0, np.zeros(k))
    width = maps[0].width + 1 if k else 0
    penalty = np.full(width, 1.0)
    penalty[-1] = 0.0
    runs = [_Run(np.zeros(width), done=n[i] == 0) for i in range(k)]
    passes = [0] * k
    groups: dict = {}
    for i, m in enumerate(maps):
        groups.setdefault(m.key, []).append(i)
    while any(not r.done for r in runs) and max(passes) < MOST_PASSES:
        asked = {i: (r.trial, STAGES[r.stage][0]) for i, r in enumerate(runs) if not r.done}
        for i, sums in summed(examples, _evaluate(maps, groups, asked, dim, k, width), merging).items():
            passes[i] += 1
            point, scale = asked[i][0], 1.0 / (c * n[i])
            loss = sums[0] / n[i] + scale * (penalty * point * point).sum() / 2
            gradient = sums[1:1 + width] / n[i] + scale * penalty * point
            hessian = sums[1 + width:].reshape(width, width) / n[i] + scale * np.diag(penalty)
            runs[i].take(loss, gradient, hessian)
    if not all(r.done for r in runs):
        warnings.warn(f"an SVM fit has not converged in {MOST_PASSES} passes", stacklevel=2)
    return [Fitted(r.point[:-1].copy(), float(r.point[-1]), p, r.done) for r, p in zip(runs, passes)]


def _square(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``z' diag(weight) z`` for weights of 0 or more."""
    rows = np.flatnonzero(weight > 0)
    root = z[rows] * np.sqrt(weight[rows])[:, None]
    return root.T @ root  # of one matrix with itself: half of a product


def weighted_squares(z: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """``z' diag(w) z`` for every column ``w`` of ``weights``.  The middle one
    of a row's weights is summed once for all columns, and for each of them what
    it has more or less: the models of a cross validation differ in the rows of
    their own fold, and in few others."""
    middle = (weights.shape[1] - 1) // 2
    shared = np.partition(weights, middle, axis=1)[:, middle]
    base = _square(z, shared)
    return [base + _square(z, rest) - _square(z, -rest) for rest in (weights - shared[:, None]).T]


def _evaluate(maps: list, groups: dict, asked: dict, dim: int, k: int, width: int):
    # models of one map at one stage are summed together
    together = {}
    for key, members in groups.items():
        for i in members:
            if i in asked:
                together.setdefault(key, {}).setdefault(asked[i][1], []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros(1 + width + width * width) for i in asked}
        for f, sign, w in _rows(batches, dim, k):
            for stages in together.values():
                some = next(iter(stages.values()))[0]
                z = np.ones((len(f), width))
                z[:, :-1] = maps[some](f)
                for h, open_ in stages.items():
                    mine = w[:, open_]
                    margins = sign[:, None] * (z @ np.stack([asked[i][0] for i in open_], axis=1))
                    loss, slope, curved = rounded_hinge(margins, h)
                    losses = (loss * mine).sum(0)
                    gradients = z.T @ (slope * sign[:, None] * mine)
                    hessians = weighted_squares(z, np.where(curved, mine / (2 * h), 0.0))
                    for j, i in enumerate(open_):
                        sums[i][0] += losses[j]
                        sums[i][1:1 + width] += gradients[:, j]
                        sums[i][1 + width:] += hessians[j].reshape(-1)
        yield pa.RecordBatch.from_pydict({"model": pa.array(list(sums), pa.int32()),
                                          "sums": pa.array([s.tobytes() for s in sums.values()], pa.binary())})
    return run
