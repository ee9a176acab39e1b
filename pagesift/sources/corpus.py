"""Corpus sources: the driver's parquet tables and the page/gold pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import normalize_text, strip_xml_decl

# Key that ties a test-corpus page to its gold document: the numeric path
# segment after a two-letter language folder, e.g. ``/en/98``.
GOLD_KEY_PATTERN = r"/[a-z]{2}/(\d+)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def gold_key(url_col="url"):
    """Gold document id encoded in a page url (NULL when absent)."""
    key = F.regexp_extract(F.col(url_col), GOLD_KEY_PATTERN, 1)
    return F.when(key != "", key.cast("bigint"))


def load_pairs(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages joined to their normalized gold text.

    Output: ``page_id BIGINT, doc_id BIGINT, html STRING, gold STRING``.
    Many pages may share one gold document; the join is an equi-join on the
    gold key (sort-merge at scale; AQE splits a hot gold document).
    """
    p = pages.select("page_id", gold_key("url").alias("doc_id"),
                     strip_xml_decl("html").alias("html"))
    g = documents.select("doc_id", normalize_text("text").alias("gold"))
    return p.join(g, "doc_id", "inner").select("page_id", "doc_id", "html", "gold")


def pages_without_gold(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """S1 report: pages whose gold document is missing (left anti join)."""
    p = pages.select("page_id", "url", gold_key("url").alias("doc_id"))
    return p.join(documents.select("doc_id"), "doc_id", "left_anti")
