"""Structured Streaming: score pages as they arrive.

    readStream(pages) -> segment -> css bags -> NB decision -> article

A naive-Bayes model fitted in batch is applied to every micro-batch by the
batch operators themselves, so a stream and a table get the same articles.
Each micro-batch is written to its own folder of the output table; a batch that
is run again after a failure replaces its folder, so rows are neither lost nor
doubled.  Table and query state lie in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators import nb as nbm
from pagesift.operators.blocks import extract_article
from pagesift.operators.segment import segment_blocks
from pagesift.session import ensure_checkpoint_dir
from pagesift.sources.corpus import gold_key
from pagesift.functions.text import strip_xml_decl


def page_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Pages arriving as parquet files in the table folder ``path``, or in the
    one file of that name; the schema is fixed, nothing is inferred.  ``max_files`` bounds
    the files of a micro-batch; unset, a micro-batch takes all that are new."""
    reader = spark.readStream.schema("page_id BIGINT, url STRING, html STRING")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern the path may be a folder or a file
    folder, _, name = path.rpartition("/")
    return reader.parquet(f"{folder}/{{{name}}}")


def score_new_pages(pages: DataFrame, model: nbm.NBModel) -> DataFrame:
    """Pages of a micro-batch (or a table) -> ``page_id, doc_id, extracted,
    fallback``; no labels are needed."""
    keyed = pages.select("page_id", gold_key("url").alias("doc_id"),
                         strip_xml_decl("html").alias("html"))
    scored = nbm.nb_predict(segment_blocks(keyed), model)
    return extract_article(scored, "prediction").select(
        "page_id", "doc_id", "extracted", "fallback")


def run_to_table(pages: DataFrame, score, name: str = "stream_articles") -> str:
    """Run a stream of pages until its input is drained (``availableNow``),
    ``score`` applied to each micro-batch, into a parquet table below the
    checkpoint folder; returns its path.  The table has a column ``batch``."""
    base = ensure_checkpoint_dir(pages.sparkSession).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = (pages.writeStream.foreachBatch(write).trigger(availableNow=True)
             .option("checkpointLocation", f"{base}/state").start())
    query.awaitTermination()
    return f"{base}/data"


def nb_counts_stream(labelled_blocks: DataFrame) -> DataFrame:
    """A3 as an update-mode streaming aggregate over labelled css long rows
    ``(label, token, cnt)``: running smoothed counts per token."""
    return labelled_blocks.groupBy("token").agg(
        (F.sum(F.col("cnt") * F.col("label")) + 1).cast("double").alias("pos_cnt"),
        (F.sum(F.col("cnt") * (1 - F.col("label"))) + 1).cast("double").alias("neg_cnt"))
