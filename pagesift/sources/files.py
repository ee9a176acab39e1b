"""File-based corpus layouts (S2/S3), charset decoding (S5) and gold text
from annotated HTML (S9).

Two directories hold the originals and the annotations; both are read with
the ``binaryFile`` source and joined on the document name (shuffle join on
the name; neither side is assumed small).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.text import normalize_text, strip_xml_decl

# ---- fixed values: directory layouts of the two corpus formats ----
LAYOUTS = {
    # name: (original subdir, annotation subdir, annotation suffix, annotation kind)
    "span_annotations": ("original", "annotated", "", "spans"),
    "plain_text": ("HTML", "Corrected", ".corrected.txt", "text"),
}
# order in which byte encodings are tried
CHARSET_CASCADE = ("utf-8", "utf-16", "windows-1252", "iso-8859-1")
# ---- end of fixed values ----


def _decode_one(raw) -> str | None:
    if raw is None:
        return None
    data = bytes(raw)
    for enc in CHARSET_CASCADE:
        try:
            return data.decode(enc)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


@F.arrow_udf(T.StringType())
def _decode_cascade(raw: pa.Array) -> pa.Array:
    return pa.array([_decode_one(b) for b in raw.to_pylist()], pa.string())


def decode_bytes(col):
    """Bytes -> text with the charset cascade (utf-8 first).

    Valid UTF-8 is decoded JVM-side; only the other rows' bytes travel to
    the Python cascade (valid rows pass NULL through Arrow)."""
    raw = F.col(col) if isinstance(col, str) else col
    as_text = raw.cast("string")
    valid = F.coalesce(F.is_valid_utf8(as_text), F.lit(False))
    return F.coalesce(F.when(valid, as_text),
                      _decode_cascade(F.when(~valid & raw.isNotNull(), raw)))


@F.arrow_udf(T.StringType())
def gold_from_spans(html: pa.Array) -> pa.Array:
    """Normalized gold text of annotated HTML."""
    from pagesift.functions.spans import SpanReader
    reader = SpanReader()
    return pa.array([reader.run(h) if isinstance(h, str) else None for h in html.to_pylist()],
                    pa.string())


def _name(path_col):
    return F.element_at(F.split(path_col, "/"), -1)


def read_layout(spark: SparkSession, base_dir: str, layout: str = "plain_text") -> DataFrame:
    """``(name, html, gold)`` for every original with an annotation.

    The annotation of ``<dir>/<orig>/<f>`` is ``<dir>/<ann>/<f><suffix>``.
    Originals without annotation are left out (see ``missing_gold``).
    """
    orig_dir, ann_dir, suffix, kind = LAYOUTS[layout]
    base = base_dir.rstrip("/")
    orig = spark.read.format("binaryFile").load(f"{base}/{orig_dir}") \
        .select(_name(F.col("path")).alias("name"), decode_bytes("content").alias("html"))
    ann = spark.read.format("binaryFile").load(f"{base}/{ann_dir}") \
        .select(_name(F.col("path")).alias("ann_name"), decode_bytes("content").alias("ann"))
    if suffix:
        ann = ann.filter(F.col("ann_name").endswith(suffix)).withColumn(
            "name", F.expr(f"substring(ann_name, 1, length(ann_name) - {len(suffix)})"))
    else:
        ann = ann.withColumn("name", F.col("ann_name"))
    if kind == "spans":
        gold = gold_from_spans(strip_xml_decl("ann"))
    else:
        gold = normalize_text("ann")
    ann = ann.select("name", gold.alias("gold"))
    return (orig.join(ann, "name", "inner")
                .select("name", strip_xml_decl("html").alias("html"), "gold"))


def missing_gold(spark: SparkSession, base_dir: str, layout: str = "plain_text") -> DataFrame:
    """Originals without an annotation file (left anti join on name)."""
    orig_dir, ann_dir, suffix, _ = LAYOUTS[layout]
    base = base_dir.rstrip("/")
    orig = spark.read.format("binaryFile").load(f"{base}/{orig_dir}").select(
        _name(F.col("path")).alias("name"))
    ann = spark.read.format("binaryFile").load(f"{base}/{ann_dir}").select(
        _name(F.col("path")).alias("ann_name"))
    if suffix:
        ann = ann.filter(F.col("ann_name").endswith(suffix)).select(F.expr(
            f"substring(ann_name, 1, length(ann_name) - {len(suffix)})").alias("name"))
    else:
        ann = ann.select(F.col("ann_name").alias("name"))
    return orig.join(ann, "name", "left_anti")
