"""Session helpers: building a local session for tests and benches, and the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Arrow batches carry whole pages into the segmentation worker; a page can be
# tens of KB, so batches are capped by rows to keep worker memory flat.
ARROW_BATCH_ROWS = 256
ARROW_BATCH_BYTES = 64 << 20
ARROW_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def get_spark(master: str | None = None, app: str = "pagesift",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session used by tests and bench.py (clusters bring their own)."""
    master = master or os.environ.get("PAGESIFT_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("PAGESIFT_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
        .config("spark.driver.memory", os.environ.get("PAGESIFT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


_TUNED: set[str] = set()


def tune(spark: SparkSession) -> None:
    """What the jobs rely on, once per application: bounded Arrow batches and
    the package on the executors.  A batch size that the application was
    started with is kept, and so is one set later."""
    app = spark.sparkContext.applicationId
    if app in _TUNED:
        return
    _TUNED.add(app)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.sparkContext.getConf().get(name) is None and spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_BATCH_ROWS))
    # a batch of long pages is cut by bytes as well
    if spark.sparkContext.getConf().get(ARROW_BYTES_CONF) is None:
        spark.conf.set(ARROW_BYTES_CONF, str(ARROW_BATCH_BYTES))
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pagesift`` importable in executor Python workers (the UDFs are
    pickled by reference), as ``--py-files`` would: zip the package once per
    application and add it to the context.  Skipped when the application
    already ships it."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if "pagesift" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(app)
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pagesift-pkg-"), "pagesift.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster's deployment sets it (a path that all executors share); without
    it a cluster job fails here rather than writing to one machine's disk.
    Only a local master gets a scratch folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pagesift-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
