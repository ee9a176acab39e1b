"""Evaluation of extracted article text against gold text.

* A10: token-set precision / recall / F1 per page (built-in array functions);
* A11/A12: LCS precision / recall / F1 and inclusion flags (Arrow UDF over
  token arrays, bit-parallel, see ``functions.lcs``);
* A13/A14: macro averages per round and the mean of round means;
* A18: data-quality diagnostics.

Edge rules: when both sides have tokens but share none, the common count is
1 (as in the reference); an empty extraction scores 0; an empty gold text
gives NULL metrics, which averages skip.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.exprs import let
from pagesift.session import ensure_checkpoint_dir
from pagesift.functions.text import whitespace_tokens

METRICS = ["precision", "recall", "f1", "lcs_precision", "lcs_recall", "lcs_f1"]


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, _ratio(2 * p * r, p + r)).when(p.isNotNull(), F.lit(0.0))


def _score_struct(common: Column, n_e: Column, n_m: Column) -> Column:
    """STRUCT<precision, recall, f1> from the common / extracted / gold counts."""
    def ratios(c):
        floor1 = F.greatest(c["common"], F.lit(1))
        p = F.when(c["nm"] == 0, F.lit(None).cast("double")) \
             .when(c["ne"] == 0, F.lit(0.0)).otherwise(_ratio(floor1, c["ne"]))
        r = F.when(c["nm"] == 0, F.lit(None).cast("double")) \
             .when(c["ne"] == 0, F.lit(0.0)).otherwise(_ratio(floor1, c["nm"]))
        return F.struct(p.alias("p"), r.alias("r"))

    def with_f1(pr):
        return F.struct(pr["p"].alias("precision"), pr["r"].alias("recall"),
                        _f1(pr["p"], pr["r"]).alias("f1"))
    counts = F.struct(common.alias("common"), n_e.alias("ne"), n_m.alias("nm"))
    return let(let(counts, ratios), with_f1)


def _token_score_struct(extracted, gold) -> Column:
    """Token-set scores of two texts; each text is tokenized once."""
    sets = F.struct(F.array_distinct(whitespace_tokens(extracted)).alias("e"),
                    F.array_distinct(whitespace_tokens(gold)).alias("m"))
    return let(sets, lambda t: _score_struct(
        F.size(F.array_intersect(t["e"], t["m"])), F.size(t["e"]), F.size(t["m"])))


def _expand(df: DataFrame, keys, col: str, prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(f"{col}.{m}").alias(prefix + m)
                              for m in ("precision", "recall", "f1")])


def eval_tokens(df: DataFrame, extracted: str = "extracted", gold: str = "gold",
                keys=("page_id",)) -> DataFrame:
    """Token-set precision, recall, F1 per page."""
    scored = df.select(*keys, _token_score_struct(extracted, gold).alias("_tm"))
    return _expand(scored, keys, "_tm", "")


@F.arrow_udf(T.IntegerType())
def lcs_length_udf(x: pa.Array, y: pa.Array) -> pa.Array:
    from pagesift.functions.lcs import lcs_length
    return pa.array([lcs_length(a or [], b or []) for a, b in zip(x.to_pylist(), y.to_pylist())],
                    pa.int32())


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def lcs_flags_udf(x: pa.Array, y: pa.Array) -> pa.Array:
    from pagesift.functions.lcs import lcs_flags
    return pa.array([lcs_flags(a or [], b or []) for a, b in zip(x.to_pylist(), y.to_pylist())],
                    pa.list_(pa.bool_()))


def _tokenized(df: DataFrame, extracted: str, gold: str, keys) -> DataFrame:
    """``_e`` and ``_m``, the tokens of both texts.  A generator of one row keeps
    them in a projection of their own below the LCS; inlined, every use of them
    would put the article together and split it again."""
    both = F.struct(whitespace_tokens(extracted).alias("_e"), whitespace_tokens(gold).alias("_m"))
    return df.select(*keys, F.explode(F.array(both)).alias("_t")).select(*keys, "_t._e", "_t._m")


def eval_lcs(df: DataFrame, extracted: str = "extracted", gold: str = "gold",
             keys=("page_id",)) -> DataFrame:
    """LCS precision (LCS / extracted tokens), recall (LCS / gold
    tokens) and F1 per page; token counts, not sets."""
    tok = _tokenized(df, extracted, gold, keys)
    with_lcs = tok.select(*keys, F.size("_e").alias("_ne"), F.size("_m").alias("_nm"),
                          lcs_length_udf("_e", "_m").alias("_lcs"))
    scored = with_lcs.select(*keys, _score_struct(F.col("_lcs"), F.col("_ne"), F.col("_nm"))
                             .alias("_lm"))
    return _expand(scored, keys, "_lm", "lcs_")


def lcs_inclusion(df: DataFrame, extracted: str = "extracted", gold: str = "gold",
                  keys=("page_id",)) -> DataFrame:
    """Per page, the extracted tokens' LCS inclusion flags."""
    tok = _tokenized(df, extracted, gold, keys)
    flagged = tok.select(*keys, "_e", lcs_flags_udf("_e", "_m").alias("flags"))
    return flagged.select(*keys, F.size("_e").alias("n_tokens"),
                          F.size(F.filter("flags", lambda f: f)).alias("n_in_lcs"), "flags")


def evaluate(df: DataFrame, extracted: str = "extracted", gold: str = "gold",
             keys=("page_id",), lcs: bool = True) -> DataFrame:
    """Per-page token metrics, plus LCS metrics when ``lcs``."""
    if not lcs:
        return eval_tokens(df, extracted, gold, keys)
    tok = _tokenized(df, extracted, gold, keys)
    counted = tok.select(*keys, "_e", "_m", F.size("_e").alias("_ne"),
                         F.size("_m").alias("_nm"),
                         let(F.struct(F.array_distinct("_e").alias("e"),
                                      F.array_distinct("_m").alias("m")),
                             lambda t: _score_struct(F.size(F.array_intersect(t["e"], t["m"])),
                                                     F.size(t["e"]), F.size(t["m"]))).alias("_tm"))
    with_lcs = counted.select(*keys, "_tm", "_ne", "_nm", lcs_length_udf("_e", "_m").alias("_lcs"))
    scored = with_lcs.select(*keys, "_tm", _score_struct(F.col("_lcs"), F.col("_ne"), F.col("_nm"))
                             .alias("_lm"))
    return scored.select(*keys, *[F.col(f"_tm.{m}").alias(m) for m in ("precision", "recall", "f1")],
                         *[F.col(f"_lm.{m}").alias("lcs_" + m) for m in ("precision", "recall", "f1")])


def eval_report(metrics: DataFrame, round_col: str = "round") -> DataFrame:
    """Macro average per round, then the unweighted mean of the
    round means (``scope = 'final'``, ``round = -1``)."""
    present = [c for c in METRICS if c in metrics.columns]
    per_round = metrics.groupBy(round_col).agg(
        F.count("*").cast("bigint").alias("n_docs"),
        F.count_if(F.col(present[0]).isNull()).cast("bigint").alias("n_skipped"),
        *[F.avg(c).alias(c) for c in present])
    # one row per round: checkpointed so the final row does not recompute the rounds
    ensure_checkpoint_dir(metrics.sparkSession)
    per_round = per_round.checkpoint()
    final = per_round.agg(
        F.lit(-1).cast("int").alias(round_col),
        F.sum("n_docs").cast("bigint").alias("n_docs"),
        F.sum("n_skipped").cast("bigint").alias("n_skipped"),
        *[F.avg(c).alias(c) for c in present])
    return (per_round.select(F.lit("round").alias("scope"), F.col(round_col).cast("int"),
                             "n_docs", "n_skipped", *present)
            .unionByName(final.select(F.lit("final").alias("scope"), round_col,
                                      "n_docs", "n_skipped", *present)))


def diagnostics(blocks_long: DataFrame, pages: DataFrame,
                word_cap: int = 500, wps_cap: int = 50) -> DataFrame:
    """Counts of the conditions the reference warns about, as
    ``(metric STRING, value BIGINT)`` rows.

    ``blocks_long`` needs ``words_raw`` and ``wps_raw`` (uncapped); ``pages``
    needs ``fallback``, ``extracted`` and ``gold``.
    """
    common = F.size(F.array_intersect(whitespace_tokens("extracted"), whitespace_tokens("gold")))
    b = blocks_long.agg(
        F.count("*").alias("n_blocks"),
        F.count_if(F.col("words_raw") > word_cap).alias("blocks_over_word_cap"),
        F.count_if(F.col("wps_raw") > wps_cap).alias("blocks_over_wps_cap"))
    p = pages.agg(
        F.count("*").alias("n_pages"),
        F.count_if("fallback").alias("pages_without_selected_block"),
        F.count_if(common == 0).alias("pages_without_common_word"),
        # an LCS is empty exactly when the two token sets are disjoint
        F.count_if(common == 0).alias("pages_without_common_subsequence"))

    def long(df):
        return df.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]),
            F.array(*[F.col(c).cast("bigint") for c in df.columns]))).alias("metric", "value"))
    return long(b).unionByName(long(p))
