"""Positions and running sums in a global order without a single-task window.

Rows are dealt to range partitions of the order key and that partitioning is
checkpointed, range number included, before anything is counted: what is
counted and what is numbered are then the same rows, however often the plan is
evaluated.  A table with one row per range gives each range its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.session import ensure_checkpoint_dir

_LOCAL_BITS = 33


def _in_ranges(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """``df`` in checkpointed range partitions, with the range number ``_part``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(n, *order)
              .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))


def _offsets(sums: DataFrame) -> DataFrame:
    """(_part, _s) -> (_part, _off, _total); one row per range, a bounded broadcast."""
    w = Window.orderBy("_part")
    return F.broadcast(sums.select(
        "_part",
        F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding,
                                       Window.unboundedFollowing)).alias("_total")))


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx",
                      total: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position of the row in ``order``, and optionally
    ``total``, the number of rows.  ``order`` must be a total order for a
    reproducible result.  The frame is written once to the checkpoint folder:
    pass the narrow columns."""
    ranged = _in_ranges(df, order, partitions)
    offsets = _offsets(ranged.groupBy("_part").agg(F.count("*").alias("_s")))
    # a checkpointed partition holds one range, so the id's lower bits are
    # the position in the range
    local = ranged.sortWithinPartitions(*order).withColumn(
        "_local", F.monotonically_increasing_id().bitwiseAND((1 << _LOCAL_BITS) - 1))
    out = local.join(offsets, "_part").withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.drop("_part", "_local", "_off", "_total")


def with_prefix_sum(df: DataFrame, order: list[Column], weight: str, name: str = "cum",
                    total: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``name``: running (inclusive) sum of ``weight`` in ``order``.

    Ranges are summed locally and shifted by the totals of the ranges before
    them.  ``order`` should be unique -- pre-aggregate ties into ``weight``
    first, which also keeps a hot value from landing in a single task."""
    ranged = _in_ranges(df, order, partitions)
    offsets = _offsets(ranged.groupBy("_part").agg(F.sum(weight).alias("_s")))
    local = ranged.withColumn("_run", F.sum(weight).over(
        Window.partitionBy("_part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = local.join(offsets, "_part").withColumn(name, F.col("_off") + F.col("_run"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_run", "_off", "_total")
