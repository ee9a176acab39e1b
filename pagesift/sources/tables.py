"""Tables that a job writes for itself below the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pagesift.session import ensure_checkpoint_dir


def fresh_path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "pages") -> DataFrame:
    """``df`` written as a table below ``spark.checkpoint.dir`` and read back,
    for frames that a job reads several times: it is computed once, its lineage
    is cut, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
