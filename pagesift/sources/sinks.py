"""Sinks and the score source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def libsvm_lines(df: DataFrame, label: str = "label", features: str = "f",
                 out: str = "line") -> DataFrame:
    """``label 1:%f 2:%f ...`` -- integer label, 1-based dense indexes,
    six decimals, zeros written."""
    pairs = F.transform(F.col(features),
                        lambda x, i: F.format_string("%d:%.6f", i + 1, F.bround(x, 6)))
    return df.withColumn(out, F.concat_ws(" ", F.col(label).cast("int").cast("string"),
                                          F.array_join(pairs, " ")))


def write_libsvm(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write libsvm lines as text part files (one line per example)."""
    df.select("line").write.mode(mode).text(path)


def read_scores(spark: SparkSession, path: str, col: str = "f1") -> DataFrame:
    """One float per line."""
    return (spark.read.text(path)
            .select(F.trim("value").alias("value")).filter(F.col("value") != "")
            .select(F.col("value").cast("double").alias(col)))


def write_scores(df: DataFrame, path: str, col: str = "f1", mode: str = "overwrite") -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def write_curve(curve: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Curve points (``x`` as %d, ``y`` as %.4f) plus mean/median."""
    (curve.select(F.format_string("%d", "x").alias("x"), F.format_string("%.4f", "y").alias("y"))
          .write.mode(mode).option("header", True).csv(f"{path}/curve"))
    summary.write.mode(mode).option("header", True).csv(f"{path}/summary")
