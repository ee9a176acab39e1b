"""Build nested page rows for operator tests."""
from pyspark.sql import types as T

BLOCK = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("css", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("label", T.IntegerType()),
])
PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
    T.StructField("body_text", T.StringType()),
    T.StructField("gold", T.StringType()),
])


def pages_df(spark, pages):
    """pages: list of (page_id, [(text, css, label), ...], body_text, gold)."""
    rows = []
    for pid, blocks, body, gold in pages:
        rows.append((pid, [(i + 1, t, c, l) for i, (t, c, l) in enumerate(blocks)], body, gold))
    return spark.createDataFrame(rows, PAGE)
