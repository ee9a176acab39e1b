"""Per-block operators on the nested ``blocks`` array (no shuffle):
gold labels (P10) and article assembly (P17/P18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.exprs import let
from pagesift.functions.text import normalize_text, remove_markers, space_count

# ---- fixed values: must equal the reference's class labels ----
POSITIVE_LABEL = 1
NEGATIVE_LABEL = 0
# a block needs more than this many spaces to count as main content
MIN_LABEL_SPACES = 2
# ---- end of fixed values ----


def label_expr(text, gold):
    """P10: 1 iff the marked text has > 2 spaces and its unmarked text is a
    case-sensitive substring of the gold text."""
    ok = (space_count(text) > MIN_LABEL_SPACES) & F.coalesce(
        gold.contains(remove_markers(text)), F.lit(False))
    return F.when(ok, F.lit(POSITIVE_LABEL)).otherwise(F.lit(NEGATIVE_LABEL))


def block_labels(df: DataFrame, gold_col: str = "gold") -> DataFrame:
    """Add ``label INT`` to every block; gold is read once per page."""
    gold = F.col(gold_col)
    return df.withColumn("blocks", F.transform(
        "blocks", lambda b: b.withField("label", label_expr(b["text"], gold))))


def extract_article(df: DataFrame, flag: str = "prediction",
                    out: str = "extracted") -> DataFrame:
    """Unmarked text of blocks with ``flag == 1`` in page order,
    normalized; a page without such a block falls back to its whole-body
    text.  Adds ``out`` and ``fallback BOOLEAN``."""
    chosen = F.filter("blocks", lambda b: b[flag] == POSITIVE_LABEL)

    def assemble(c):
        none = F.size(c) == 0
        joined = normalize_text(F.array_join(
            F.transform(c, lambda b: remove_markers(b["text"])), "\n"))
        return F.struct(F.when(none, F.col("body_text")).otherwise(joined).alias("text"),
                        none.alias("fallback"))
    # the selected blocks are filtered once, then read twice
    art = let(chosen, assemble)
    return (df.withColumn("_art", art)
              .withColumn(out, F.col("_art.text"))
              .withColumn("fallback", F.col("_art.fallback"))
              .drop("_art"))


def with_gold_predictions(df: DataFrame) -> DataFrame:
    """Use the gold label as the prediction (upper bound of block selection)."""
    return df.withColumn("blocks", F.transform(
        "blocks", lambda b: b.withField("prediction", b["label"])))
