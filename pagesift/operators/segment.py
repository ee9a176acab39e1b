"""Block segmentation as an Arrow batch UDF (one walk per page), then
nested column expressions for positions and css token bags."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.text import css_tokens, token_bag

_RAW_BLOCK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("css_src", T.ArrayType(T.StringType())),
])
_RAW_PAGE = T.StructType([
    T.StructField("raw_blocks", T.ArrayType(_RAW_BLOCK)),
    T.StructField("body_text", T.StringType()),
])


@F.arrow_udf(_RAW_PAGE)
def _walk_pages(html: pa.Array) -> pa.Array:
    """One Arrow batch of pages -> their raw blocks, built as flat columns
    plus offsets (no per-block Python dicts)."""
    from pagesift.functions.html_blocks import BlockWalker

    walker = BlockWalker()
    page_ends, texts, css_ends, css_values, bodies = [0], [], [0], [], []
    for page in html.to_pylist():
        found, body = walker.run(page or "")
        for text, sources in found:
            texts.append(text)
            css_values.extend(sources)
            css_ends.append(len(css_values))
        page_ends.append(len(texts))
        bodies.append(body)
    css = pa.ListArray.from_arrays(pa.array(css_ends, pa.int32()),
                                   pa.array(css_values, pa.string()))
    blocks = pa.StructArray.from_arrays([pa.array(texts, pa.string()), css],
                                        names=["text", "css_src"])
    raw = pa.ListArray.from_arrays(pa.array(page_ends, pa.int32()), blocks)
    return pa.StructArray.from_arrays([raw, pa.array(bodies, pa.string())],
                                      names=["raw_blocks", "body_text"])


def spread_for_python(df: DataFrame) -> DataFrame:
    """Deal out a batch input that fills less than half of the cores, so the
    Python stage uses them all.  A large input has a split for every core
    already and is never reshuffled before the walk."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def segment_blocks(docs: DataFrame, html_col: str = "html", spread: bool = True) -> DataFrame:
    """Replace ``html`` by ``blocks ARRAY<STRUCT<pos INT, text STRING,
    css MAP<STRING,INT>>>`` and ``body_text STRING`` (normalized whole-body
    text, the fallback article).

    The UDF runs in its own projection so its struct is evaluated once; the
    css bag of a block is the summed token bags of its css sources, built
    with built-in higher-order functions.
    """
    if spread:
        docs = spread_for_python(docs)
    others = [c for c in docs.columns if c != html_col]
    walked = docs.select(*others, _walk_pages(F.col(html_col)).alias("_seg"))
    # tokens are materialized once per block, then counted (the bag reads
    # the token array several times)
    no_tokens = F.array().cast("array<string>")
    no_bag = F.create_map().cast("map<string,int>")
    tokenized = walked.select(*others, F.transform(
        F.col("_seg.raw_blocks"),
        lambda b, i: F.struct(
            (i + 1).cast("int").alias("pos"), b["text"].alias("text"),
            F.when(F.size(b["css_src"]) == 0, no_tokens)
            .otherwise(F.flatten(F.transform(b["css_src"], css_tokens))).alias("tokens")))
        .alias("_tok"), F.col("_seg.body_text").alias("body_text"))
    blocks = F.transform("_tok", lambda b: F.struct(
        b["pos"].alias("pos"), b["text"].alias("text"),
        F.when(F.size(b["tokens"]) == 0, no_bag).otherwise(token_bag(b["tokens"])).alias("css")))
    return tokenized.select(*others, blocks.alias("blocks"), "body_text")


def explode_blocks(df: DataFrame, keep=()) -> DataFrame:
    """Long form: one row per block (no shuffle; rows stay on their page's task)."""
    keys = [c for c in df.columns if c not in ("blocks", "body_text", "gold", "html")]
    keys += [c for c in keep if c not in keys]
    # outer generator + null filter: an inner one lets the optimizer infer
    # ``size(blocks) > 0`` and push it below the UDF, evaluating it twice
    return df.select(*keys, F.inline_outer("blocks")).filter(F.col("pos").isNotNull())
