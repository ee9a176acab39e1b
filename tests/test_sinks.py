"""Sinks and the score source; ordering helpers under skewed ties."""
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from pagesift.operators.curve import score_curve, score_summary
from pagesift.operators.ordering import with_global_index, with_prefix_sum
from pagesift.sources.sinks import (libsvm_lines, read_scores, write_curve, write_libsvm,
                                    write_scores)


def test_libsvm_file(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.0]), (0, [1.0, 0.25])], "label int, f array<double>")
    out = str(tmp_path / "dump")
    write_libsvm(libsvm_lines(df), out)
    lines = sorted(l.strip() for p in glob.glob(f"{out}/part-*") for l in open(p))
    assert lines == ["0 1:1.000000 2:0.250000", "1 1:0.500000 2:0.000000"]


def test_scores_roundtrip_and_curve_files(spark, tmp_path):
    df = spark.createDataFrame([(0.5,), (0.5,), (1.0,), (0.25,)], "f1 double")
    path = str(tmp_path / "scores")
    write_scores(df, path)
    back = read_scores(spark, path)
    assert sorted(r["f1"] for r in back.collect()) == [0.25, 0.5, 0.5, 1.0]
    out = str(tmp_path / "curve")
    write_curve(score_curve(back), score_summary(back), out)
    rows = sorted(l.strip() for p in glob.glob(f"{out}/curve/part-*") for l in open(p)
                  if not l.startswith("x"))
    assert rows == ["1,1.0000", "3,0.5000", "4,0.2500"]


def test_curve_and_median_with_a_hot_value(spark):
    rnd = random.Random(7)
    vals = [1.0] * 400 + [round(rnd.random(), 3) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "f1 double").repartition(13)
    curve = {r["y"]: r["x"] for r in score_curve(df).collect()}
    for y, x in curve.items():
        assert x == sum(1 for v in vals if v >= y)
    s = score_summary(df).first()
    srt = sorted(vals)
    assert s["median"] == pytest.approx((srt[499] + srt[500]) / 2)
    assert s["mean"] == pytest.approx(sum(vals) / len(vals))


def test_prefix_sum_and_index_agree(spark):
    df = spark.range(0, 500, 1, 9).withColumn("w", F.lit(1))
    a = {r["id"]: r["cum"] for r in with_prefix_sum(df, [F.col("id")], "w", "cum").collect()}
    b = {r["id"]: r["idx"] for r in with_global_index(df, [F.col("id")], "idx").collect()}
    assert all(a[k] == b[k] + 1 for k in a) and len(a) == 500


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_index_of_wide_rows_is_a_permutation(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(0, 60_000, 1, 11).select(
            F.xxhash64("id").alias("k"), F.array_repeat(F.col("id"), 20).alias("wide"),
            F.concat(F.lit("text "), F.col("id")).alias("text"))
        first, second = (
            {r["k"]: r["idx"] for r in
             with_global_index(df, [F.col("k")], "idx", partitions=7).select("k", "idx").collect()}
            for _ in range(2))
        assert first == {k: i for i, k in enumerate(sorted(first))} and len(first) == 60_000
        assert first == second
        sums = with_prefix_sum(df.withColumn("w", F.lit(2)), [F.col("k")], "w", "cum", partitions=7)
        assert {r["k"]: r["cum"] for r in sums.select("k", "cum").collect()} == {
            k: 2 * (i + 1) for k, i in first.items()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_splits_of_many_wide_rows(spark):
    from pagesift.operators.split import holdout_split, kfold_assign, sample_docs, stratified_folds
    n = 50_000
    df = spark.range(0, n, 1, 9).select(
        (F.col("id") * 7).alias("page_id"), F.array_repeat(F.col("id"), 10).alias("wide"),
        (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(1).alias("pos"))
    copies = df.unionByName(df.where("page_id % 2 = 0"))
    split = holdout_split(copies, 0.7)
    assert split.where("split = 'train'").select("page_id").distinct().count() == int(n * 0.7)
    assert split.agg(F.max(F.when(F.col("split") == "train", F.col("page_id")))
                     < F.min(F.when(F.col("split") == "test", F.col("page_id")))).first()[0]
    sizes = {r["fold"]: r["n"] for r in kfold_assign(copies, 7).groupBy("fold").agg(
        F.count_distinct("page_id").alias("n")).collect()}
    assert sizes == {**{i: n // 7 for i in range(7)}, None: n % 7}
    one, two = (sorted(r["page_id"] for r in sample_docs(df, 15_000).select("page_id").collect())
                for _ in range(2))
    assert one == two and len(one) == 15_000
    folds = stratified_folds(df, 10).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        part = [r["count"] for r in folds if r["label"] == label]
        total = sum(part)
        assert len(part) == 10 and set(part) <= {total // 10, -(-total // 10)}
