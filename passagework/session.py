"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that keep skewed joins and over-partitioned shuffles in check.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed partitions even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A Python worker holds several copies of a batch: 10,000 long texts at once are too many.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 24),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller already owns."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("passagework")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (shared storage on a cluster).

    Without that setting a temporary folder is used, which is only allowed when
    driver and executors share one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; set one only when it is unset."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="passagework-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly work on a scan with few splits.

    A table with at least as many splits as the cluster has cores stays as it is,
    which is every table of a size that matters.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back: a lineage cut that
    survives lost executors and lets later branches share one computation."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Functions run in workers are pickled by reference to their module, and a worker
    does not see the driver's import path.
    """
    context = spark.sparkContext
    if getattr(context, "_passagework_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="passagework-"), "passagework.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._passagework_shipped = True
