"""A naive-Bayes model that is kept up to date (A1-A5, M3 over changing pages).

The counts of a model are sums over pages, so a page that changes or goes is
taken out again: an update appends the page's new counts and, with a minus, its
former ones.  Two logs below one folder hold the state, both partitioned by
update: ``pages`` (page, version, its counts; null once withdrawn) and
``deltas`` (signed sums by token).  An update is part of the state as soon as
its deltas are written; its pages are written first, and an update that broke
off is written anew.  Versions make deliveries idempotent: what is not newer
than the state is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.nb import NBModel, _model

BAG = "bag array<struct<token:string,pos:bigint,neg:bigint,cells:bigint>>"
PAGES = f"page_id long, version long, n_blocks long, n_positive long, {BAG}, update int"
DELTAS = "token string, pos long, neg long, cells long, n_blocks long, n_positive long, update int"


def page_counts(pages: DataFrame) -> DataFrame:
    """(page_id, version, n_blocks, n_positive, bag) of labelled pages with a
    ``version``; ``blocks`` NULL withdraws a page (bag NULL).  No shuffle: a
    page is one row, its bag an entry for each token of each block."""
    bag = F.flatten(F.transform("blocks", lambda b: F.transform(F.map_entries(b["css"]), lambda e: F.struct(
        e["key"].alias("token"), (e["value"] * b["label"]).cast("long").alias("pos"),
        (e["value"] * (1 - b["label"])).cast("long").alias("neg"), F.lit(1).cast("long").alias("cells")))))
    there = F.col("blocks").isNotNull()
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("version").cast("long").alias("version"),
        F.when(there, F.size("blocks")).cast("long").alias("n_blocks"),
        F.when(there, F.size(F.filter("blocks", lambda b: b["label"] == 1))).cast("long").alias("n_positive"),
        bag.alias("bag"))


def _signed(pages: DataFrame, sign: int) -> DataFrame:
    """Counts as rows by token; a row without token carries the page's blocks."""
    tokens = pages.select(F.inline("bag")).select(
        "token", *[(F.col(c) * sign).alias(c) for c in ("pos", "neg", "cells")],
        F.lit(0).cast("long").alias("n_blocks"), F.lit(0).cast("long").alias("n_positive"))
    zero = F.lit(0).cast("long")
    blocks = pages.where("bag is not null").select(
        F.lit(None).cast("string").alias("token"), zero.alias("pos"), zero.alias("neg"), zero.alias("cells"),
        (F.col("n_blocks") * sign).alias("n_blocks"), (F.col("n_positive") * sign).alias("n_positive"))
    return tokens.unionByName(blocks)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "cells", "n_blocks", "n_positive")])


def _latest(pages: DataFrame) -> DataFrame:
    """The row of the highest version of each page."""
    fields = [c for c in pages.columns if c not in ("page_id", "update")]
    best = F.max_by(F.struct(*fields), F.col("version"))
    return pages.groupBy("page_id").agg(best.alias("r")).select("page_id", "r.*")


@dataclass
class NBState:
    """The state below ``path``, a folder that all executors share."""
    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as problem:  # no update so far
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], schema)

    def deltas(self) -> DataFrame:
        return self._read("deltas", DELTAS)

    def last_update(self) -> int:
        return self.deltas().agg(F.max("update")).first()[0] or 0

    def pages(self) -> DataFrame:
        """Every page's newest counts, withdrawn ones with a NULL bag."""
        return _latest(self._read("pages", PAGES).where(F.col("update") <= self.last_update()))

    def update(self, changes: DataFrame) -> int:
        """Take up labelled pages (page_id, version, blocks; blocks NULL for
        withdrawn ones) and return the update's number.  Of several rows of a
        page the highest version counts (of equal ones any: a version is one
        content).  Versions that are not newer than the state's are ignored;
        NULL page ids or versions are left out."""
        number = self.last_update() + 1
        given = _latest(page_counts(changes.where("page_id is not null and version is not null")))
        known = self.pages().select("page_id", F.col("version").alias("_known"))
        fresh = given.join(known, "page_id", "left").where("_known is null or version > _known").drop("_known")
        fresh.write.mode("overwrite").parquet(f"{self.path}/pages/update={number}")
        fresh = self.spark.read.schema(PAGES.removesuffix(", update int")).parquet(f"{self.path}/pages/update={number}")
        former = self.pages().join(fresh.select("page_id"), "page_id", "left_semi")
        delta = _summed(_signed(fresh, 1).unionByName(_signed(former, -1)))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/update={number}")
        return number

    def model(self) -> NBModel:
        """The model of the pages as they are now, equal to a fit on them."""
        sums = _summed(self.deltas())
        counts = sums.where("token is not null and cells > 0").select(
            "token", (F.col("pos") + 1).cast("double").alias("pos_cnt"), (F.col("neg") + 1).cast("double").alias("neg_cnt"))
        whole = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_blocks", "n_positive", "cells")]).first()
        return _model(counts, int(whole["n_blocks"]), int(whole["n_positive"]), int(whole["cells"]))
