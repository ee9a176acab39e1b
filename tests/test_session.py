"""Session helpers and the pre-UDF spreading gate."""
import pytest

from pagesift import session
from pagesift.operators import segment


def test_spread_only_inputs_of_few_splits(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert segment.spread_for_python(pages.coalesce(1)).rdd.getNumPartitions() == cores
    many = pages.repartition(cores)
    assert segment.spread_for_python(many) is many


def test_no_scratch_folder_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_checkpoint_dir_and_shipping_are_idempotent(spark):
    first = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == first
    session.ship_package(spark)
    session.ship_package(spark)
    assert spark.sparkContext.applicationId in session._SHIPPED
