"""Score summaries (A15-A17, W3), distributed.

The median and the cumulative curve need positions in score order.  Scores
are first folded into distinct values with counts, written as a small table (so
a value shared by a third of all documents is one row).  The two middle scores
are found by radix selection on it; for the curve ``ordering.with_prefix_sum``
gives running counts with range partitions and per-partition offsets -- no
single-task window and no collect of all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.ordering import with_prefix_sum
from pagesift.operators.selection import keys_at
from pagesift.sources.tables import stored


def _distinct_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-NULL scores with their counts (partial aggregation folds
    a hot score before the shuffle), written so the ordering passes read this
    small table instead of recomputing the pages."""
    return stored(df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
                    .groupBy("v").agg(F.count("*").alias("c")), "scores")


def score_summary(df: DataFrame, col: str = "f1") -> DataFrame:
    """``n``, ``mean`` and ``median`` (mean of the two middle values for
    an even count) of the non-NULL scores in ``col``; NULL without any."""
    return summary_of_counts(_distinct_counts(df, col))


def summary_of_counts(counts: DataFrame) -> DataFrame:
    """``score_summary`` of distinct scores ``v`` with their numbers ``c``."""
    middle = keys_at(counts, F.col("v"), lambda n: [(n - 1) // 2, n // 2], weight=F.col("c")).get(None, {})
    values = [middle[min(middle)], middle[max(middle)]] if middle else [None, None]
    return counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        ((F.lit(values[0]).cast("double") + F.lit(values[1]).cast("double")) / 2).alias("median"))


def score_curve(df: DataFrame, col: str = "f1") -> DataFrame:
    """For each distinct score ``y`` (descending), ``x`` = number of
    documents scoring at least ``y``."""
    return curve_of_counts(_distinct_counts(df, col))


def curve_of_counts(counts: DataFrame) -> DataFrame:
    """``score_curve`` of distinct scores ``v`` with their numbers ``c``."""
    cum = with_prefix_sum(counts, [F.col("v").desc()], "c", "x")
    return cum.select(F.col("x").cast("bigint").alias("x"), F.col("v").alias("y"))


def cv_summary(df: DataFrame, col: str) -> DataFrame:
    """Number of folds, mean and two population standard deviations."""
    return df.agg(F.count(col).cast("bigint").alias("n_folds"),
                  F.avg(col).alias("mean"),
                  (2 * F.stddev_pop(col)).alias("two_std"))
