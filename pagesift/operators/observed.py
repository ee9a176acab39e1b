"""A18 in the same pass: the counts of ``evaluate.diagnostics`` gathered by
``observe`` while a job writes its pages, with no scan of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagesift.functions.text import whitespace_tokens
from pagesift.sources.tables import stored


def _blocks_over(field: str, cap: int) -> Column:
    over = F.size(F.filter("blocks", lambda b: b[field] > cap))
    return F.coalesce(F.sum(F.greatest(over, F.lit(0))), F.lit(0))


def watched(articles: DataFrame, word_cap: int = 500, wps_cap: int = 50) -> tuple[DataFrame, Observation]:
    """``articles`` (``blocks`` with ``words_raw`` and ``wps_raw``, ``fallback``,
    ``extracted``, ``gold``) unchanged, and the observation that an action on
    them fills.

    The counts are those of the tasks' output rows.  Let the observed frame be
    written, with no shuffle behind it: then every row is counted once, a task
    that is run again included.  A page whose ``blocks`` is NULL counts as a
    page without blocks, one whose text or gold is NULL has no common word."""
    watch = Observation()
    words = F.size(F.array_intersect(whitespace_tokens("extracted"), whitespace_tokens("gold")))
    # -1 where a side is NULL
    shared = articles.withColumn("_shared", F.coalesce(words, F.lit(-1)) <= 0)
    none = F.count_if("_shared")
    seen = shared.observe(
        watch,
        F.coalesce(F.sum(F.greatest(F.size("blocks"), F.lit(0))), F.lit(0)).alias("n_blocks"),
        _blocks_over("words_raw", word_cap).alias("blocks_over_word_cap"),
        _blocks_over("wps_raw", wps_cap).alias("blocks_over_wps_cap"),
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("fallback").alias("pages_without_selected_block"),
        none.alias("pages_without_common_word"),
        # an LCS is empty exactly when the two token sets are disjoint
        none.alias("pages_without_common_subsequence"))
    return seen.drop("_shared"), watch


def stored_with_diagnostics(articles: DataFrame, name: str = "articles") -> tuple[DataFrame, DataFrame]:
    """``articles`` written below ``spark.checkpoint.dir`` and read back, and
    the ``(metric STRING, value BIGINT)`` rows counted while they were written."""
    seen, watch = watched(articles)
    table = stored(seen, name)
    rows = [(metric, int(value)) for metric, value in watch.get.items()]
    return table, articles.sparkSession.createDataFrame(rows, "metric STRING, value BIGINT")
