"""A13-A16 on a stream: averages and curve of scores as they arrive.

A micro-batch leaves two small tables: the sums of its rounds, and its distinct
scores with their numbers.  They are written to the batch's own folder, which a
batch that is run again replaces, so a restart or a replay counts nothing twice.
Reading sums them up: the report so far is always that of all batches written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.curve import curve_of_counts, summary_of_counts
from pagesift.operators.evaluate import METRICS


class EvaluationState:
    """Sums and score counts below ``base``, a folder that all executors share.
    ``present`` are the metrics that the scored batches bring; ``score`` is the
    one whose distribution is kept."""

    def __init__(self, spark: SparkSession, base: str, present=("precision", "recall", "f1"), score: str = "f1"):
        self.spark, self.base, self.score = spark, base.rstrip("/"), score
        self.present = [m for m in METRICS if m in present]

    def add(self, metrics: DataFrame, batch: int) -> None:
        """Take in a batch of per-page metrics with their ``round``.  Metrics
        that are NULL are left out of the averages and counted as skipped; rows
        without a round belong to none; an empty batch adds nothing."""
        rows = metrics.where(F.col("round").isNotNull())
        # all that the two tables need, by one aggregate over the pages
        kept = rows.groupBy(F.col("round").cast("int").alias("round"), F.col(self.score).alias("v")).agg(
            F.count("*").alias("n_docs"), F.count_if(F.col(self.present[0]).isNull()).alias("n_skipped"),
            *[F.sum(m).alias(f"sum_{m}") for m in self.present], *[F.count(m).alias(f"n_{m}") for m in self.present])
        kept.write.mode("overwrite").parquet(f"{self.base}/parts/batch={batch}")

    def _parts(self) -> DataFrame:
        sums = "".join(f", sum_{m} DOUBLE" for m in self.present) + "".join(f", n_{m} BIGINT" for m in self.present)
        return self.spark.read.schema(
            f"round INT, v DOUBLE, n_docs BIGINT, n_skipped BIGINT{sums}").parquet(f"{self.base}/parts")

    def report(self) -> DataFrame:
        """The rows of ``evaluate.eval_report`` for all batches so far."""
        rounds = self._parts().groupBy("round").agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_skipped").alias("n_skipped"),
            *[F.try_divide(F.sum(f"sum_{m}"), F.sum(f"n_{m}")).alias(m) for m in self.present])
        final = rounds.agg(F.lit(-1).alias("round"), F.sum("n_docs").alias("n_docs"),
                           F.sum("n_skipped").alias("n_skipped"), *[F.avg(m).alias(m) for m in self.present])
        return (rounds.select(F.lit("round").alias("scope"), "*")
                .unionByName(final.select(F.lit("final").alias("scope"), "*")))

    def _counts(self) -> DataFrame:
        scored = self._parts().where(F.col("v").isNotNull())
        return scored.groupBy("v").agg(F.sum("n_docs").alias("c"))

    def summary(self) -> DataFrame:
        """``curve.score_summary`` of all batches so far."""
        return summary_of_counts(self._counts())

    def curve(self) -> DataFrame:
        """``curve.score_curve`` of all batches so far."""
        return curve_of_counts(self._counts())


def evaluate_stream(pages: DataFrame, score, state: EvaluationState) -> EvaluationState:
    """Score a stream of pages until its input is drained (``availableNow``):
    ``score`` turns a micro-batch into per-page metrics with their ``round``.
    Started again on the same state, it goes on behind the last whole batch."""
    query = (pages.writeStream.foreachBatch(lambda batch, number: state.add(score(batch), number))
             .trigger(availableNow=True).option("checkpointLocation", f"{state.base}/query").start())
    query.awaitTermination()
    return state
