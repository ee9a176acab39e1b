"""J1/S1 on a stream: pages and gold texts that arrive apart from each other.

A stream-stream left outer join on the gold key, both sides under a watermark:
a page waits for its gold for a set time; a page whose gold has not come by then
is reported without it, where a batch job would list it as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import normalize_text, strip_xml_decl
from pagesift.sources.corpus import gold_key
from pagesift.sources.tables import fresh_path

# An hour that no arrival reaches: ends a drained stream.
END = "9000-01-01 00:00:00"
# The key of the row that ends the gold; keys of urls have no sign.
NO_DOCUMENT = -1


def pair_streams(pages: DataFrame, gold: DataFrame, wait: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(page_id, doc_id, html, gold, without_gold)`` of every page.

    ``pages`` has ``page_id, url, html, arrived``; ``gold`` has ``doc_id, text,
    arrived`` with one row a document.  Gold counts if it arrives at most
    ``wait`` before or after the page; rows may come out of order by up to
    ``late``; rows later than that are dropped by the watermark, as Spark counts
    in its progress reports.  State is kept for ``wait`` + ``late`` only.  A page
    without a key waits like any other and is reported; a gold text that is NULL
    is a gold that came.  A row that states no arrival arrives now."""
    def arrival(name):
        return F.coalesce("arrived", F.current_timestamp()).alias(name)
    p = pages.select("page_id", gold_key("url").alias("doc_id"), strip_xml_decl("html").alias("html"),
                     arrival("page_at")).withWatermark("page_at", late)
    g = gold.select(F.col("doc_id").alias("gold_id"), normalize_text("text").alias("gold"),
                    arrival("gold_at")).withWatermark("gold_at", late)
    met = F.expr(f"doc_id = gold_id AND gold_at BETWEEN page_at - INTERVAL {wait} AND page_at + INTERVAL {wait}")
    return p.join(g, met, "left_outer").select(
        "page_id", "doc_id", "html", "gold", F.col("gold_id").isNull().alias("without_gold"), "page_at")


def with_end(stream: DataFrame, **values) -> DataFrame:
    """``stream`` and one row with arrival at ``END``, which carries the
    watermark past all that waits when the input has been drained.  The row is
    NULL but for ``values``: gold needs a key there, as rows without one are
    filtered out before the watermark sees them."""
    spark: SparkSession = stream.sparkSession
    path = fresh_path(spark, "stream-end")
    spark.createDataFrame([tuple(values.get(c) for c in stream.columns)], stream.schema).withColumn(
        "arrived", F.lit(END).cast("timestamp")).coalesce(1).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def run_pairs(pages: DataFrame, gold: DataFrame, **options) -> DataFrame:
    """Drain both streams (``availableNow``) into a table below the checkpoint
    folder and read it: every page once, paired or reported without gold."""
    spark = pages.sparkSession
    base = fresh_path(spark, "stream-pairs")
    paired = pair_streams(with_end(pages), with_end(gold, doc_id=NO_DOCUMENT), **options)
    query = (paired.where(F.col("page_at") < F.lit(END).cast("timestamp")).drop("page_at")
             .writeStream.format("parquet").option("path", f"{base}/data")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/data")
