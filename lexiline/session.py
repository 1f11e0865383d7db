"""Session helpers: settings the operators rely on and the checkpoint folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they can be applied to a session somebody else made.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small intermediate tables still get one task per core: dictionary work is bound by CPU, not bytes.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
    # Split a skewed join side even when that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as `--py-files` would; once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexiline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="lexiline-"), "lexiline"), "zip", root, "lexiline"
    )
    sc.addPyFile(archive)
    sc._lexiline_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and make the package available to it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def build(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "lexiline", **conf) -> SparkSession:
    """A session for local use; on a cluster, call `tune` on the given one."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    A temporary folder is chosen only where none is configured and the master is local, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        configured = tempfile.mkdtemp(prefix="lexiline-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an intermediate table reliably (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
