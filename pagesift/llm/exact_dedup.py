"""Exact dedup with two passes of a Bloom filter.

Pass one counts the rows' hashes into a Bloom filter with saturating counters
(none, once, more than once).  Pass two tests every row: a row with a counter
that stands at once can't be repeated and passes straight through; only the
others are shuffled, by the SHA-256 of their normalised text, and decided
exactly.  The filter has a fixed greatest size, so what is broadcast is bounded;
a fuller filter lets more rows through to the shuffle and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.bits import filter_bits, set_bits, tester
from pagesift.llm.common import join_skewed, read_table, stash


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    clean = normalised(F.col(text))
    return docs.select(F.col(doc_id).alias("id"), F.sha2(clean, 256).alias("sha"),
                       F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"),
                       F.xxhash64(clean).alias("h"))


def _decide(docs: DataFrame, doc_id: str, text: str):
    """(rows with ``maybe``, groups of the rows that may be repeated, tester)."""
    rows = stash(_digests(docs, doc_id, text), "digests")
    total = rows.count()
    maybe = tester(docs.sparkSession,
                   set_bits(rows.select("h"), filter_bits(total), repeated=True))
    rows = stash(rows.withColumn("maybe", maybe("h")), "tested")
    best = F.max(F.struct(F.col("chars"), -F.col("id"), F.col("id").alias("keep"))).alias("best")
    groups = stash(rows.where("maybe").groupBy("sha").agg(best, F.count("*").alias("n"))
                   .select("sha", F.col("best.keep").alias("keep"), "n"), "groups")
    return rows, groups, maybe, total


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so without white space; of equal ones the
    longest, then the smallest id stays.  Null text counts as empty (all empty
    texts are equal).  A null id is last among ties.  Rows that repeat an id
    and its text count apart in ``group_size`` and share one verdict.  Further
    columns are left out; an empty table gives no rows."""
    rows, groups, _, total = _decide(docs, doc_id, text)
    alone = rows.where("not maybe").select("id", "sha", F.col("id").alias("keep"),
                                           F.lit(1).cast("long").alias("n"))
    met = join_skewed(rows.where("maybe").select("id", "sha"), groups, "sha", "n", total)
    return alone.unionByName(met).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.  Rows that can't
    be repeated are not shuffled.  Of rows with the id and the text of the one
    that stays, one stays.  Nulls, empty texts and tables as in
    ``exact_dedup``; other columns may have any names."""
    rows, groups, maybe, _ = _decide(docs, doc_id, text)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    clean = normalised(F.col(text))
    held = docs.select(F.col(doc_id).alias("_id"), F.sha2(clean, 256).alias("_sha"),
                       maybe(F.xxhash64(clean)).alias("_maybe"), whole.alias("_row"))
    keepers = groups.select(F.col("sha").alias("_s"), F.col("keep").alias("_k"))
    chosen = (held.where("_maybe")
              .join(keepers, (F.col("_sha") == F.col("_s")) & F.col("_id").eqNullSafe(F.col("_k")),
                    "left_semi")
              .groupBy("_sha").agg(F.first("_row").alias("_row")))
    return held.where("not _maybe").select("_row.*").unionByName(chosen.select("_row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


EXACT_DEDUP_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as sha
  from documents)
select doc_id,
       first_value(doc_id) over g as keep_id,
       count(*) over (partition by sha) as group_size,
       doc_id = first_value(doc_id) over g as kept,
       sha as text_sha256
from d
window g as (partition by sha order by chars desc, doc_id
             rows between unbounded preceding and unbounded following)
"""
