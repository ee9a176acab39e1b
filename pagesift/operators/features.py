"""Block features as nested array expressions (one row per page, no shuffle).

* shallow text / densitometric (P11-P16, W2): 7 values per block;
* relative position (W1): 1 value;
* indicative class tokens (P21): ``n`` binary values for learned tokens.

The previous-block quotients read ``blocks[i-1]`` inside ``transform``; a
page is one row, so the "window" never leaves the task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.exprs import let
from pagesift.functions.text import (anchor_text, remove_markers, sentence_count,
                                     space_count)

# ---- fixed values: must equal the reference's feature constants ----
NUM_WORDS_CAP = 500
NUM_WORDS_PER_SENTENCE_CAP = 50
CHARS_PER_LINE = 80
POSITION_BUCKETS = 5
SHALLOW_TEXT_FEATURES = ["num_words", "words_per_sentence", "text_density",
                         "link_density", "num_words_q", "words_per_sentence_q",
                         "text_density_q"]
# ---- end of fixed values ----

SHALLOW_TEXT = "shallow_text"
RELATIVE_POSITION = "relative_position"
INDICATIVE_TOKENS = "indicative_tokens"


def _text_parts(b: Column) -> Column:
    """Stage 1: the regex work, once per block."""
    return (b.withField("_plain", remove_markers(b["text"]))
             .withField("_link_words", space_count(anchor_text(b["text"]))))


def _counts(b: Column) -> Column:
    """Stage 2: integer counts from the unmarked text (0 -> 1)."""
    plain = b["_plain"]
    return (b.withField("words_raw", F.greatest(space_count(plain), F.lit(1)))
             .withField("_lines", F.greatest(
                 F.floor(F.length(plain) / CHARS_PER_LINE).cast("int"), F.lit(1)))
             .withField("_sentences", F.greatest(sentence_count(plain), F.lit(1))))


def _densities(b: Column) -> Column:
    """Stage 3: the four per-block values (words and words/sentence capped)."""
    words = b["words_raw"].cast("double")
    wps = words / b["_sentences"]
    return (b.dropFields("_plain")
             .withField("wps_raw", wps)
             .withField("num_words", F.least(words, F.lit(float(NUM_WORDS_CAP))))
             .withField("words_per_sentence",
                        F.least(wps, F.lit(float(NUM_WORDS_PER_SENTENCE_CAP))))
             .withField("text_density", words / b["_lines"])
             .withField("link_density", b["_link_words"].cast("double") / words)
             .dropFields("_lines", "_sentences", "_link_words"))


def block_features(df: DataFrame) -> DataFrame:
    """Add the seven shallow-text values to every block (plus the uncapped
    ``words_raw``/``wps_raw`` used by diagnostics).

    Each stage is its own ``transform`` so a value computed in one stage is
    read, not recomputed, by the next.
    """
    staged = F.transform(F.transform(F.transform("blocks", _text_parts), _counts), _densities)

    def with_quotients(arr):
        def one(b, i):
            prev = F.get(arr, F.greatest(i - 1, F.lit(0)))
            return (b.withField("num_words_q", b["num_words"] / prev["num_words"])
                     .withField("words_per_sentence_q",
                                b["words_per_sentence"] / prev["words_per_sentence"])
                     .withField("text_density_q", b["text_density"] / prev["text_density"]))
        return F.transform(arr, one)
    # the staged array is bound once; each block reads its predecessor from it
    return df.withColumn("blocks", let(staged, with_quotients))


def block_features_window(blocks_long: DataFrame, key: str = "page_id") -> DataFrame:
    """Long-form variant of ``block_features``: one row per block, the
    previous block read with ``lag`` over ``(key) ORDER BY pos``.  Same
    values; kept to measure against the nested form -- the window needs a
    shuffle by page, the nested form does not."""
    b = F.struct(*[F.col(c) for c in blocks_long.columns if c != key])
    staged = blocks_long.select(key, F.inline(F.array(_densities(_counts(_text_parts(b))))))
    w = Window.partitionBy(key).orderBy("pos")
    out = staged
    for c in ("num_words", "words_per_sentence", "text_density"):
        out = out.withColumn(c + "_q", F.col(c) / F.coalesce(F.lag(c).over(w), F.col(c)))
    return out


def relative_position(df: DataFrame) -> DataFrame:
    """``ceil(i / (n / 5))`` for 1-based block ``i`` of ``n``, as double
    (float arithmetic, as the reference computes it)."""
    n = F.size("blocks").cast("double")
    return df.withColumn("blocks", F.transform(
        "blocks", lambda b, i: b.withField(
            "rel_pos", F.ceil((i + 1).cast("double") / (n / float(POSITION_BUCKETS))).cast("double"))))


def indicative_values(css: Column, tokens: Column, n: int) -> Column:
    """``n`` binary values, 1 when the block's bag holds the k-th learned
    token; a shorter token list leaves trailing zeros."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda k: F.when(F.coalesce(
            F.array_contains(F.map_keys(css), F.try_element_at(tokens, k)), F.lit(False)),
            F.lit(1.0)).otherwise(F.lit(0.0)))


def feature_dim(spec: Sequence) -> int:
    dim = 0
    for item in spec:
        name = item[0] if isinstance(item, tuple) else item
        if name == SHALLOW_TEXT:
            dim += len(SHALLOW_TEXT_FEATURES)
        elif name == RELATIVE_POSITION:
            dim += 1
        elif name == INDICATIVE_TOKENS:
            dim += int(item[1])
        else:
            raise ValueError(f"unknown feature extractor {name!r}")
    return dim


def feature_vectors(df: DataFrame, spec: Sequence = (SHALLOW_TEXT,),
                    tokens: Sequence[str] | None = None) -> DataFrame:
    """P20/M9: per block ``f ARRAY<DOUBLE>``, the selected extractors'
    values concatenated in ``spec`` order.

    ``spec`` items: ``"shallow_text"``, ``"relative_position"`` or
    ``("indicative_tokens", n)`` (needs the learned ``tokens``).
    """
    spec = list(spec)
    if not spec:
        raise ValueError("at least one feature extractor is required")
    feature_dim(spec)
    names = [s[0] if isinstance(s, tuple) else s for s in spec]
    if SHALLOW_TEXT in names and "num_words_q" not in _block_fields(df):
        df = block_features(df)
    if RELATIVE_POSITION in names and "rel_pos" not in _block_fields(df):
        df = relative_position(df)
    token_arr = F.array(*[F.lit(t) for t in (tokens or [])]).cast("array<string>")

    def vec(b):
        parts = []
        for item in spec:
            name = item[0] if isinstance(item, tuple) else item
            if name == SHALLOW_TEXT:
                parts.append(F.array(*[b[c] for c in SHALLOW_TEXT_FEATURES]))
            elif name == RELATIVE_POSITION:
                parts.append(F.array(b["rel_pos"]))
            else:
                parts.append(indicative_values(b["css"], token_arr, int(item[1])))
        return b.withField("f", F.concat(*parts) if len(parts) > 1 else parts[0])
    return df.withColumn("blocks", F.transform("blocks", vec))


def _block_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema["blocks"].dataType.elementType.fields]


def training_examples(df: DataFrame, keys=("page_id",)) -> DataFrame:
    """Long form ``(keys, pos, label, f)`` for model fitting."""
    # outer generator + null filter keeps the optimizer from inferring a
    # filter on ``blocks`` and pushing it below the segmentation UDF
    rows = df.select(*keys, F.inline_outer(F.transform(
        "blocks", lambda b: F.struct(b["pos"].alias("pos"), b["label"].alias("label"),
                                     b["f"].alias("f")))))
    return rows.filter(F.col("pos").isNotNull())


def unique_examples(examples: DataFrame) -> DataFrame:
    """One row per distinct (label, features) pair (hash aggregate)."""
    return examples.select("label", "f").dropDuplicates(["label", "f"])


def label_stats(examples: DataFrame) -> DataFrame:
    """Number of examples and of positive examples."""
    return examples.agg(F.count("*").cast("bigint").alias("n_examples"),
                        F.count_if(F.col("label") == 1).cast("bigint").alias("n_positive"))
