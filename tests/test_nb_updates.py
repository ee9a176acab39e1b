"""An updated naive-Bayes model against a fit on the pages as they are."""
import random

from pyspark.sql import functions as F

from pagesift.operators.nb import nb_fit, with_text_bags
from pagesift.operators.nb_updates import NBState
from pagesift.plans import jobs
from pagesift.plans.queries import page_changes

SCHEMA = "page_id long, version long, blocks array<struct<pos:int,label:int,css:map<string,int>>>"


def table(model):
    tokens = {r["token"]: tuple(round(v, 9) for v in tuple(r)[1:]) for r in model.table.collect()}
    return tokens, round(model.prior, 9), model.n_blocks, model.n_tokens, model.nnz


def fit_of(spark, now):
    rows = [(i, v, b) for i, (v, b) in now.items() if b is not None]
    return table(nb_fit(spark.createDataFrame(rows, SCHEMA)))


def random_blocks(rng):
    return [{"pos": p, "label": rng.randint(0, 1), "css": {f"t{rng.randint(0, 12)}": rng.randint(1, 3) for _ in range(rng.randint(0, 4))}}
            for p in range(rng.randint(0, 4))]


def test_random_updates_equal_a_refit(spark, tmp_path):
    rng = random.Random(1)
    state, now = NBState(spark, str(tmp_path / "state")), {}
    for _ in range(4):
        changes = {}
        for _ in range(8):
            page, version = rng.randint(0, 9), rng.randint(1, 12)
            if (page, version) not in changes:
                changes[page, version] = None if rng.random() < 0.25 else random_blocks(rng)
        taken = [(p, v, b) for (p, v), b in changes.items()]
        for p, v, b in sorted(taken, key=lambda r: r[1]):
            if v > now.get(p, (0, None))[0]:
                now[p] = (v, b)
        rows = spark.createDataFrame(taken + taken[:2] + [(None, 1, []), (3, None, [])], SCHEMA)
        state.update(rows)
        got, want = table(state.model()), fit_of(spark, now)
        assert got == want
        before = got
        state.update(rows)          # delivered once more: nothing is new
        assert table(state.model()) == before


def test_an_update_that_broke_off_is_written_anew(spark, tmp_path):
    state = NBState(spark, str(tmp_path / "state"))
    first = spark.createDataFrame([(1, 1, [{"pos": 1, "label": 1, "css": {"a": 2}}])], SCHEMA)
    second = spark.createDataFrame([(1, 2, [{"pos": 1, "label": 0, "css": {"b": 1}}])], SCHEMA)
    state.update(first)
    want = table(state.model())
    # its pages are there, its deltas are not
    state.spark.read.parquet(f"{state.path}/pages/update=1").withColumn("version", F.lit(9).cast("long")).write.parquet(
        f"{state.path}/pages/update=2")
    assert table(state.model()) == want and state.pages().first()["version"] == 1
    assert state.update(second) == 2
    assert set(table(state.model())[0]) == {"b"}


def test_empty_state_and_everything_withdrawn(spark, tmp_path):
    state = NBState(spark, str(tmp_path / "state"))
    assert table(state.model())[0] == {}
    state.update(spark.createDataFrame([(1, 1, [{"pos": 1, "label": 1, "css": {"a": 2}}]), (2, 1, None)], SCHEMA))
    state.update(spark.createDataFrame([(1, 2, None)], SCHEMA))
    assert table(state.model()) == ({}, 0.0, 0, 0, 0)


def test_given_pages(spark, sf_small, tmp_path):
    pages = jobs.stored(with_text_bags(jobs.labelled_pages(spark, sf_small)))
    state = NBState(spark, str(tmp_path / "state"))
    for changes in page_changes(pages):
        state.update(changes)
    now = pages.where("page_id % 5 <> 1").withColumn("blocks", F.when(
        F.col("page_id") % 3 == 0, F.filter("blocks", lambda b: b["pos"] % 2 == 1)).otherwise(F.col("blocks")))
    got, want = table(state.model()), table(nb_fit(now))
    assert got == want
