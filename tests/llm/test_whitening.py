import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesift.llm.whitening import (COMPONENTS, eigen, one_sided_jacobi, op12_whitening, pivoted_cholesky,
                                    whiten_vectors, whole_numbers)

SCHEMA = "vec_id long, embedding array<float>, v string, x string, n long"


def brute(rows, k=COMPONENTS):
    """rows: (id, list of finite floats of equal length)."""
    x = {i: [int(np.floor(256.0 * float(np.float32(c)))) for c in v] for i, v in rows}
    listed = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, sums = len(listed), [int(s) for s in listed.sum(0)]
    c = listed.astype(float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        w = (np.array(v, float) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), w)
    return out, values / np.trace(c.T @ c / n)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA)


def compare(got, rows, k=COMPONENTS):
    want, explained = brute(rows, k)
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, r)
    assert set(by_row) == set(want)
    for c in range(1, k + 1):
        pairs = [(by_row[i][c].whitened, want[i][2][c - 1]) for i in want]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-8
    for i, rows_of in by_row.items():
        for c, r in rows_of.items():
            assert (r.n, r.deviation) == want[i][:2]
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert r.identity_error < 1e-8


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 7)) * np.array([3, 2, 1.5, 1, .5, .3, .1])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]          # a third are copies
    got = whiten_vectors(frame(spark, rows)).collect()
    assert len(got) == len(rows) * COMPONENTS
    compare(got, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist()) for i in range(12)]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 0.0, 0.0])]
    got = whiten_vectors(frame(spark, good + bad)).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good}
    compare(got, good, 3)      # three dimensions, three components


def test_short_vectors_null_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(10)]
    short = [(20, rows[1][1][:2]), (21, [])]
    got = whiten_vectors(frame(spark, rows + short)).collect()
    compare(got, rows + [(20, rows[1][1][:2] + [0.0, 0.0]), (21, [0.0] * 4)])
    again = whiten_vectors(frame(spark, rows + [(None, rows[0][1]), (3, rows[3][1])])).collect()
    assert sum(r.vec_id is None for r in again) == 4 and sum(r.vec_id == 3 for r in again) == 8
    assert {r.n for r in again} == {10}


def test_no_spread_and_empty(spark):
    assert whiten_vectors(frame(spark, [])).collect() == []
    assert whiten_vectors(frame(spark, [(1, None)])).collect() == []
    assert whiten_vectors(frame(spark, [(1, [])])).collect() == []
    assert whiten_vectors(frame(spark, [(1, [.5, .25]), (2, [.5, .25])])).collect() == []
    line = whiten_vectors(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and line[0].explained == pytest.approx(1)


def test_large_entries(spark):
    """Entries beyond a long are cut; deviations beyond a long are null."""
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 3.0]), (3, [2.0, 5.0])]
    got = whiten_vectors(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(r.deviation is None for r in got if r.vec_id != 3)
    assert all(np.isfinite(r.whitened) for r in got)


def test_whole_numbers():
    import pyarrow as pa
    x = whole_numbers(pa.array([[0.0, -0.0, -0.001], [1 / 256, 1.0, -1 / 256]], pa.list_(pa.float64())), 3)
    assert x.tolist() == [[0, 0, -1], [1, 256, -1]]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 20), st.integers(0, 2**32))
def test_eigen(d, rows, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(rows, d)) * 10.0 ** rng.integers(-3, 3, d)
    s = a.T @ a
    factor, order = pivoted_cholesky(s)
    assert np.allclose(factor @ factor.T, s[np.ix_(order, order)], atol=1e-10 * s.max())
    assert (np.triu(factor, 1) == 0).all()
    u = one_sided_jacobi(factor)
    gram = u.T @ u
    assert np.abs(gram - np.diag(gram.diagonal())).max(initial=0) <= 1e-12 * s.max()
    values, vectors = eigen(s)
    want = np.linalg.eigvalsh(s)[::-1]
    assert np.allclose(values, want[:len(values)], rtol=1e-8, atol=1e-10 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-8)


def test_given_embeddings(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    compare(op12_whitening(spark, sf_small).collect(), ok)
