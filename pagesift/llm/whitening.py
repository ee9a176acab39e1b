"""Whitening of embeddings by principal components of a fit list.

Entries become whole numbers x = floor(256 c).  The fit list holds every
distinct vector of them once.  Spark sums it, then sums the products of its
centred vectors (two passes, partial sums in every partition, merged in two
steps by matrix row).  The driver gets one d x d matrix: a Cholesky
decomposition with pivoting gives its triangular factor, and one-sided Jacobi
rotations on that factor make its columns orthogonal, so that their squared
norms are the eigenvalues and the columns, normalised, the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import read_table, stash

SCALE = 256.0
COMPONENTS = 4
PARTS = 32             # first step of merging: so many groups for each matrix row
ROWS_PER_PRODUCT = 4096
MOST_SWEEPS = 60       # rotations end long before, at their tolerance
_LONG_MAX = 2**63 - 1
SUMS = "at int, sums binary"


# --- eigenvectors -----------------------------------------------------------

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L', L lower trapezoidal of as many
    columns as the positive semidefinite ``a`` has rank."""
    d = len(a)
    order, rest = np.arange(d), a.astype(np.float64).copy()
    factor = np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[p, p] <= floor:
            return factor[:, :k], order
        swap = [p, k]
        rest[[k, p]], factor[[k, p]] = rest[swap], factor[swap]
        rest[:, [k, p]] = rest[:, swap]
        order[[k, p]] = order[swap]
        factor[k:, k] = rest[k:, k] / np.sqrt(rest[k, k])
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds of disjoint pairs."""
    ring = np.arange(n + n % 2)
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        x, y = ring[:half], ring[half:][::-1]
        real = (x < n) & (y < n)
        yield np.minimum(x, y)[real], np.maximum(x, y)[real]
        ring = np.r_[ring[:1], ring[-1:], ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` with its columns rotated until all are orthogonal, by falling
    norm."""
    u = factor.copy()
    tolerance = np.finfo(float).eps * max(len(u), 1) ** 0.5
    for _ in range(MOST_SWEEPS):
        turned = False
        for i, j in _rounds(u.shape[1]):
            x, y = u[:, i], u[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            far = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if not far.any():
                continue
            turned = True
            i, j, x, y = i[far], j[far], x[:, far], y[:, far]
            zeta = (yy[far] - xx[far]) / (2 * xy[far])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            u[:, i], u[:, j] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return u[:, np.argsort(-(u * u).sum(0), kind="stable")]


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of a positive semidefinite matrix, by
    falling value, positive ones only.  A vector's largest entry is positive."""
    factor, order = pivoted_cholesky(scatter)
    rotated = np.empty_like(factor)
    rotated[order] = one_sided_jacobi(factor)
    values = (rotated * rotated).sum(0)
    vectors = rotated / np.sqrt(values)
    at = np.argmax(np.abs(vectors), axis=0) if vectors.size else np.zeros(0, int)
    return values, vectors * np.sign(vectors[at, np.arange(len(at))])


# --- sums over all rows -----------------------------------------------------

def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(256 c) of every entry, at the ends of long if beyond them.
    Vectors of fewer than ``dim`` entries are filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * flat)
    inside = np.abs(x) < 2.0**63
    whole = np.where(inside, x, 0).astype(np.int64)
    whole[~inside] = np.where(x[~inside] > 0, _LONG_MAX, -2**63)
    if (sizes == dim).all():
        return whole.reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def _matrices(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """The vectors of a binary column of longs, some thousand at a time."""
    for at in range(0, len(column), ROWS_PER_PRODUCT):
        raw = column.slice(at, ROWS_PER_PRODUCT).to_pylist()
        yield np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), dim)


def _sum_rows(rows: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray],
              shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices ``of`` (some vectors) over all ``rows`` (x binary),
    whole numbers exactly.  Only one matrix reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _matrices(batch.column(0), dim):
                part = of(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(range(shape[0]), pa.int32()),
                "sums": pa.array([_pack(r) for r in total], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = sum(_unpack(raw.as_py()) for raw in table["sums"])
        return pa.table({"at": table["at"][:1], "sums": pa.array([_pack(total)], pa.binary())})

    merged = (rows.select("x").mapInArrow(run, SUMS)
              .withColumn("part", F.spark_partition_id() % PARTS)
              .groupBy("at", "part").applyInArrow(lambda key, t: merge(t.select(["at", "sums"])), SUMS)
              .groupBy("at").applyInArrow(merge, SUMS))
    got = {r["at"]: _unpack(bytes(r["sums"])) for r in merged.collect()}  # shape[0] rows
    return np.stack([got[i] for i in range(shape[0])]) if got else np.zeros(shape)


def _pack(row: np.ndarray) -> bytes:
    """A row of doubles, or of whole numbers of any size as text."""
    return b"d" + row.tobytes() if row.dtype == np.float64 else b"n" + ",".join(map(str, row.tolist())).encode()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"d":
        return np.frombuffer(raw[1:], np.float64)
    return np.array([int(v) for v in raw[1:].split(b",")], object)


def _whole_sums(x: np.ndarray) -> np.ndarray:
    """[1 and the sums of the columns], exact: halves of 32 bits do not overflow."""
    high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
    return np.array([[len(x), *[(h << 32) + lo for h, lo in zip(high, low)]]], object)


@dataclass
class Whitening:
    n: int                 # vectors of the fit list
    sums: list[int]        # of each dimension
    vectors: np.ndarray    # d x k components
    values: np.ndarray     # their eigenvalues, falling
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2, exact; None beyond a long."""
        rough = self.n * (x - self.mean)
        out = (rough * rough).sum(1).tolist()
        reach = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums), default=0)
        if reach < 2**62:
            off = self.n * x - np.array(self.sums, np.int64)
            exact = (off * off).sum(1).tolist()   # right where the sum is a long
        else:
            exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        wrong = [i for i, r in enumerate(out) if r > 9e18]
        for i in wrong:
            exact[i] = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums))
        return [v if v <= _LONG_MAX else None for v in exact]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n; the whole part of the mean goes first, exactly."""
    whole = [s // n for s in sums]
    part = np.array([(s - n * w) / n for s, w in zip(sums, whole)])
    if max(map(abs, whole), default=0) < 2**62 and np.abs(x).max(initial=0) < 2**62:
        return (x - np.array(whole, np.int64)).astype(np.float64) - part
    return x.astype(np.float64) - np.array([float(w) for w in whole]) - part


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) without null vectors and those with null or non-finite entries."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
            .where(v.isNotNull() & finite))


def _encoded(rows: DataFrame, dim: int) -> DataFrame:
    @F.arrow_udf("binary")
    def whole(v: pa.Array) -> pa.Array:
        return pa.array([r.tobytes() for r in whole_numbers(v, dim)], pa.binary())
    return rows.select("vec_id", whole("v").alias("x"))


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows`` (vec_id, x); None
    without rows.  Two passes over the fit list give the scatter, two more the
    covariance of the whitened list."""
    listed = stash(rows.select("x").distinct(), "fit")
    total = _sum_rows(listed, dim, _whole_sums, (1, dim + 1))[0].tolist()
    n, sums = int(total[0]), [int(s) for s in total[1:]]
    if not n:
        return None

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        return c.T @ c

    covariance = _sum_rows(listed, dim, products, (dim, dim)) / n
    values, vectors = eigen(covariance)
    k = min(components, len(values))
    model = Whitening(n, sums, vectors[:, :k], values[:k], float(np.trace(covariance)))
    if k:
        mean = _sum_rows(listed, dim, lambda x: model.whiten(x).sum(0, keepdims=True), (1, k))[0] / n

        def white(x: np.ndarray) -> np.ndarray:
            c = model.whiten(x) - mean
            return c.T @ c
        model.identity_error = float(np.abs(_sum_rows(listed, dim, white, (k, k)) / n - np.eye(k)).max())
    return model


OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
       "identity_error double")


def _apply(model: Whitening, dim: int):
    k = len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices(batch.column(1), dim):
                rows = len(x)
                ids = batch.column(0).slice(at, rows)
                at += rows
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(again),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, model.n, np.int64)),
                    "deviation": pa.array(model.deviations(x), pa.int64()).take(again),
                    "whitened": pa.array(model.whiten(x).reshape(-1)),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * k, model.identity_error))})
    return run


def whiten_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                   components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` and component: vec_id, component
    (from 1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null or holds a null, NaN or infinite entry are left
    out.  Of vectors of different lengths the shorter ones are filled up with
    zeros; entries beyond a long are cut to its ends.  Repeated rows and rows
    with a null id give rows each, equal vectors count once in the fit list.
    Components of eigenvalue zero are left out (one distinct vector, or none:
    no rows); between equal eigenvalues any orthogonal choice is made, the same
    for all rows.  ``deviation`` is null where it is beyond a long.  Other
    columns are not read; an empty table gives no rows."""
    usable = _usable(vectors, vec_id, vector)
    dim = usable.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    rows = _encoded(usable, dim)
    model = fit(rows, dim, components) if dim else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], OUT)
    return rows.selectExpr("cast(vec_id as long) vec_id", "x").mapInArrow(_apply(model, dim), OUT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(read_table(spark, sf_dir, "embeddings"))
