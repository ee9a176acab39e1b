"""Radix selection against sorting; splits on wide rows with ties and NULLs."""
import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from pagesift.operators import selection as S
from pagesift.operators import split as P
from pagesift.operators.curve import score_summary


def at(keys, positions, distinct=False):
    order = sorted(set(keys) if distinct else keys)
    return {p: order[p] for p in positions(len(order)) if 0 <= p < len(order)}


def spots(n):
    return [0, 1, n // 3, n // 2, n - 2, n - 1, n, 5 * n]


KEYS = {
    "long": [random.Random(1).randrange(-2**63, 2**63) for _ in range(3000)] + [-2**63, 2**63 - 1] + [7] * 1500,
    "dense": list(range(5000, 12000)) + [6000] * 3000,
    "int": [random.Random(2).randrange(-50, 50) for _ in range(2000)],
    "double": [random.Random(3).gauss(0, 1) for _ in range(3000)] + [0.5] * 1500 + [1e300, -1e300, 1.7e308, -1.7e308, 5e-324, 0.0],
    "string": [f"{random.Random(4).random()}"[:k % 19] for k in range(3000)] + ["a", "a\x00", "ab", "é", "日本", ""] + ["same"] * 1500,
    "alike": ["x" * 40 + f"{i:06d}" for i in range(3000)],
    "date": [dt.date(2020, 1, 1) + dt.timedelta(days=i % 700) for i in range(2000)],
    "decimal(20,4)": [decimal.Decimal(random.Random(5).randrange(10**12)) / 10000 for _ in range(1000)],
    "boolean": [True, False, True],
}


@pytest.mark.parametrize("kind", list(KEYS))
@pytest.mark.parametrize("few", [0, 500])
def test_like_sorting(spark, kind, few, monkeypatch):
    monkeypatch.setattr(S, "FEW_KEYS", few)
    keys = KEYS[kind]
    column = {"dense": "long", "alike": "string"}.get(kind, kind)
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)] * 5, f"k {column}")
    mapped = {"date": lambda d: (d - dt.date(1970, 1, 1)).days, "boolean": int}.get(kind, lambda k: k)
    for distinct in (False, True):
        got = S.keys_at(df, F.col("k"), spots, distinct=distinct)
        assert got == {None: {p: mapped(k) for p, k in at(keys, spots, distinct).items()}}


def test_groups_and_weights(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(300), rng.randrange(1, 5)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, k int, c int")
    sizes = {}
    got = S.keys_at(df, F.col("k"), spots, group=F.col("g"), weight=F.col("c"), totals=sizes)
    for g in ("a", "b", None):
        spread = [k for h, k, c in rows if h == g for _ in range(c)]
        assert got[g] == at(spread, spots) and sizes[g] == len(spread)
    assert S.keys_at(df.where("false"), F.col("k"), spots) == {}


@pytest.fixture(scope="module")
def wide(spark):
    """50,000 wide rows: 30,000 keys, one of them in a third of all rows, some NULL."""
    key = F.when(F.col("id") % 3 == 0, F.lit(77)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 30011)
    return spark.range(50_000).select(key.cast("long").alias("page_id"), F.repeat(F.lit("wide row "), 50).alias("html"))


def test_splits_of_wide_rows(wide):
    keys = sorted({r[0] for r in wide.select("page_id").collect() if r[0] is not None})
    n, k = len(keys), 7
    place = {key: i for i, key in enumerate(keys)}
    folded = P.kfold_assign(wide, k)
    for r in folded.select("page_id", "fold").distinct().collect():
        want = None if r.page_id is None or place[r.page_id] >= k * (n // k) else place[r.page_id] // (n // k)
        assert r.fold == want
    split = P.holdout_split(wide, 0.7)
    for r in split.where("page_id is not null").select("page_id", "split").distinct().collect():
        assert r.split == ("train" if place[r.page_id] < int(n * 0.7) else "test")
    sample = P.sample_docs(wide, 1000)
    assert sample.select("page_id").distinct().count() == 1000
    assert P.sample_docs(wide, 10**6).count() == 50_000 == P.sample_docs(wide, 0).count()
    for df in (folded, split, sample):
        plan = df._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan and "checkpoint" not in plan.lower()


def test_stratified_folds_of_wide_rows(spark):
    rows = [(i, i % 7, 1 if i % 3 == 0 else 0) for i in range(3000)] + [(5, 5, 1)] * 1000
    df = spark.createDataFrame(rows, "page_id long, pos int, label int")
    got = P.stratified_folds(df, 10).groupBy("label", "fold").count().collect()
    assert {r["fold"] for r in got} == set(range(10))
    apart = [r["count"] for r in got if r["label"] == 0]
    assert max(apart) - min(apart) <= 1


def test_score_summary_like_the_definition(spark):
    rng = random.Random(7)
    for scores in ([0.5], [0.1, 0.9], [rng.random() for _ in range(999)] + [0.25] * 500, [1.0] * 10):
        df = spark.createDataFrame([(s,) for s in scores] + [(None,)], "f1 double")
        r = score_summary(df).first()
        s = sorted(scores)
        assert r["n"] == len(s) and r["mean"] == pytest.approx(sum(s) / len(s))
        assert r["median"] == pytest.approx((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)
    none = score_summary(spark.createDataFrame([(None,)], "f1 double")).first()
    assert (none["n"], none["mean"], none["median"]) == (0, None, None)
