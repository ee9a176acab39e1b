"""The content model as a saved stage, the block table function, observed
diagnostics, and the streams of scores and of page/gold pairs."""
import datetime
import json
import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from pagesift.functions.block_table import register_block_table
from pagesift.operators.blocks import block_labels
from pagesift.operators.content_classifier import ContentClassifier, ContentClassifierModel, names_of, spec_of
from pagesift.operators.curve import score_curve, score_summary
from pagesift.operators.evaluate import diagnostics, eval_report, eval_tokens
from pagesift.operators.features import block_features
from pagesift.operators.observed import stored_with_diagnostics, watched
from pagesift.operators.segment import explode_blocks
from pagesift.plans import jobs
from pagesift.plans.jobs import FULL_SPEC
from pagesift.sources.corpus import read_table
from pagesift.streaming.evaluation import EvaluationState, evaluate_stream
from pagesift.streaming.pairs import run_pairs
from pagesift.streaming.scoring import page_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def pages(spark, sf_small):
    return jobs.stored(jobs.labelled_pages(spark, sf_small))


def _decisions(predicted):
    rows = predicted.select("page_id", F.inline("blocks")).select("page_id", "pos", "prediction").collect()
    return sorted(map(list, rows))


FRESH = """
import json, sys
from pagesift.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2)
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
rows = PipelineModel.load(sys.argv[1]).transform(spark.read.parquet(sys.argv[2])).select("page_id", F.inline("blocks"))
print("ROWS" + json.dumps(sorted(map(list, rows.select("page_id", "pos", "prediction").collect()))))
"""


def test_saved_pipeline_in_a_fresh_session(pages, tmp_path):
    table, path = str(tmp_path / "pages"), str(tmp_path / "model")
    pages.write.parquet(table)
    stage = ContentClassifier(names_of(FULL_SPEC), components=32)
    model = Pipeline(stages=[stage]).fit(pages)
    expected = _decisions(model.transform(pages))
    assert {d[2] for d in expected} == {0, 1}
    model.write().save(path)
    with pytest.raises(Exception):
        model.write().save(path)       # nothing is overwritten unasked
    assert _decisions(PipelineModel.load(path).transform(pages)) == expected
    done = subprocess.run([sys.executable, "-c", FRESH, path, table], cwd=ROOT, capture_output=True, text=True,
                          timeout=300)
    found = [line[4:] for line in done.stdout.splitlines() if line.startswith("ROWS")]
    assert found and json.loads(found[0]) == expected, done.stderr[-2000:]


def test_parameters_survive(spark, tmp_path):
    stage = ContentClassifier(["shallow_text", "indicative_tokens:4"], unique=False, components=16, seed=7)
    stage.write().save(str(tmp_path / "stage"))
    again = ContentClassifier.load(str(tmp_path / "stage"))
    assert {p.name: again.getOrDefault(p) for p in again.params} == {p.name: stage.getOrDefault(p) for p in stage.params}
    assert again.spec() == ("shallow_text", ("indicative_tokens", 4)) == spec_of(names_of(again.spec()))


def test_block_table_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<body><p class='a b'>one two</p><p>three <a href='#'>four</a></p></body>"), (4, "<")]
    spark.createDataFrame(rows, "page_id INT, html STRING").createOrReplaceTempView("odd_pages")
    name = register_block_table(spark)
    found = spark.sql(f"SELECT page_id, b.* FROM odd_pages, LATERAL {name}(html) b ORDER BY page_id, pos").collect()
    mine = [r for r in found if r["page_id"] == 3]
    assert [r["pos"] for r in mine] == [1, 2] and mine[0]["text"] == "one two" and "a b" in [c.strip() for c in mine[0]["css_src"]]
    assert not [r for r in found if r["page_id"] in (1, 2)]
    kept = spark.sql(f"SELECT page_id FROM odd_pages LEFT JOIN LATERAL {name}(html) b ON true")
    assert {r[0] for r in kept.collect()} == {1, 2, 3, 4}


def test_observed_counts_in_one_pass(spark, pages):
    art = block_features(jobs.gold_article(pages))
    expected = dict(map(tuple, diagnostics(explode_blocks(art), art).collect()))
    table, counts = stored_with_diagnostics(art)
    assert dict(map(tuple, counts.collect())) == expected
    assert sorted(table.columns) == sorted(art.columns) and table.count() == pages.count()
    seen, _ = watched(art)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CollectMetrics" in plan and "Exchange" not in plan


def test_observed_counts_of_nothing(spark, pages):
    art = block_features(jobs.gold_article(pages))
    _, counts = stored_with_diagnostics(art.where("page_id < 0"))
    assert {v for _, v in counts.collect()} == {0}


def _score(documents):
    def score(batch):
        found = eval_tokens(jobs.gold_article(block_labels(jobs.page_blocks(batch, documents))))
        return found.withColumn("round", (F.col("page_id") % 3).cast("int"))
    return score


def _close(a, b):
    return len(a) == len(b) and all(
        x == pytest.approx(y, rel=1e-12, nan_ok=True) if isinstance(x, float) else x == y
        for left, right in zip(a, b) for x, y in zip(left, right))


def _sorted(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_scores_after_a_stop_and_a_replay(spark, sf_small, tmp_path):
    source, documents = read_table(spark, sf_small, "pages"), read_table(spark, sf_small, "documents")
    folder = str(tmp_path / "arriving")
    source.repartition(4).write.parquet(folder)
    score, state = _score(documents), EvaluationState(spark, str(tmp_path / "state"))
    stopped = []

    class Stopping(EvaluationState):
        def add(self, metrics, batch):
            super().add(metrics, batch)
            if batch == 2 and not stopped:
                stopped.append(batch)      # written, but not committed: the batch runs again
                raise RuntimeError("stopped")
    with pytest.raises(Exception):
        evaluate_stream(page_stream(spark, folder, max_files=1), score, Stopping(spark, state.base))
    assert stopped == [2]
    evaluate_stream(page_stream(spark, folder, max_files=1), score, state)
    batches = sorted(n for n in os.listdir(f"{state.base}/parts") if n.startswith("batch="))
    assert batches == [f"batch={i}" for i in range(4)]
    whole = score(source)
    cols = ("scope", "round", "n_docs", "n_skipped", "precision", "recall", "f1")
    assert _close(_sorted(state.report(), *cols), _sorted(eval_report(whole), *cols))
    assert _sorted(state.curve(), "x", "y") == _sorted(score_curve(whole), "x", "y")
    assert _close(_sorted(state.summary(), "n", "mean", "median"), _sorted(score_summary(whole), "n", "mean", "median"))
    # pages that arrive later are added
    source.where("page_id % 7 = 0").write.mode("append").parquet(folder)
    evaluate_stream(page_stream(spark, folder, max_files=1), score, state)
    again = whole.unionByName(whole.where("page_id % 7 = 0"))
    assert _close(_sorted(state.report(), *cols), _sorted(eval_report(again), *cols))


def test_state_takes_nulls_ties_and_empty_batches(spark, tmp_path):
    state = EvaluationState(spark, str(tmp_path / "state"))
    schema = "page_id INT, round INT, precision DOUBLE, recall DOUBLE, f1 DOUBLE"
    rows = [(1, 0, 0.5, 0.5, 0.5), (2, 0, None, None, None), (3, 1, 0.5, 1.0, 0.5), (4, None, 1.0, 1.0, 1.0)]
    state.add(spark.createDataFrame(rows, schema), 0)
    state.add(spark.createDataFrame([], schema), 1)
    state.add(spark.createDataFrame(rows[:1], schema), 2)
    state.add(spark.createDataFrame(rows[:1], schema), 2)       # a replay
    cols = ("scope", "round", "n_docs", "n_skipped", "f1")
    assert _sorted(state.report(), *cols) == [("final", -1, 4, 1, 0.5), ("round", 0, 3, 1, 0.5), ("round", 1, 1, 0, 0.5)]
    assert _sorted(state.curve(), "x", "y") == [(3, 0.5)]


def test_pairs_of_late_and_missing_gold(spark, tmp_path):
    def at(minute):
        return datetime.datetime(2024, 5, 1) + datetime.timedelta(minutes=minute)
    url = "http://example.org/en/{}"
    pages = [(1, url.format(10), "<p>a</p>", at(0)), (2, url.format(11), "<p>b</p>", at(1)),
             (3, url.format(12), "<p>c</p>", at(2)), (4, "http://example.org/about", None, at(3)),
             (5, url.format(10), "", at(29)), (6, url.format(14), "<p>f</p>", at(4)), (7, url.format(13), "<p>g</p>", at(5))]
    gold = [(10, " the  gold ", at(10)), (11, "too late", at(40)), (13, None, at(20)), (14, "before", at(-20)), (99, "x", at(0))]
    for name, rows, schema in (("pages", pages, "page_id BIGINT, url STRING, html STRING, arrived TIMESTAMP"),
                               ("gold", gold, "doc_id BIGINT, text STRING, arrived TIMESTAMP")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
               for n in ("pages", "gold")]
    found = {r["page_id"]: (r["doc_id"], r["gold"], r["without_gold"]) for r in run_pairs(*streams).collect()}
    assert found == {1: (10, "the gold", False), 2: (11, None, True), 3: (12, None, True), 4: (None, None, True),
                     5: (10, "the gold", False), 6: (14, "before", False), 7: (13, None, False)}


def test_pairs_of_empty_streams(spark, tmp_path):
    for name, schema in (("pages", "page_id BIGINT, url STRING, html STRING, arrived TIMESTAMP"),
                         ("gold", "doc_id BIGINT, text STRING, arrived TIMESTAMP")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    pages, gold = (spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
                   for n in ("pages", "gold"))
    assert run_pairs(pages, gold).count() == 0
