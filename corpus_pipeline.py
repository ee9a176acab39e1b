"""A corpus pipeline of five stages over ``documents``.

Every stage reads what the one before has written as Parquet and works on all
of it: documents of low quality go, then exact copies, then all but one of each
group of near copies; what is left is put in the order of its mixture and
packed into sequences that are numbered in this order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import in_written_order, read_table, stash
from pagesift.llm.exact_dedup import drop_copies
from pagesift.llm.mixing import in_mixed_order
from pagesift.llm.ngram_join import drop_near_copies
from pagesift.llm.packing import pack_documents
from pagesift.llm.quality_fm import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by operator 6; null text counts as empty and
    has a score too; null and repeated ids are judged row by row; no rows give none."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (operator 5): the longest, then the smallest id, then one
    of equal rows; null counts as empty.  Null ids go last; no rows give none."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (operator 7), told apart by sets, not by ids; rows
    without a word all stay; no rows give none."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of operator 9; a null source is a stream of its own, null text
    counts as empty; repeated rows all stay; no rows give none."""
    return in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 1, numbered in the order in which ``docs`` was written as Parquet;
    null counts as empty, repeated ids are packed row by row; no rows give none."""
    return pack_documents(in_written_order(docs.select("doc_id", "text")), with_ids=False)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("mixture", mixture), ("packing", packing)]
ORACLE_SQL = None  # a fitted model, hashed links and packing; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
