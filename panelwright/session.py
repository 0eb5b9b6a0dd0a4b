"""Session settings and small run-time services shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in bytes of its optimized plan statistics, that an operator may broadcast itself.
BROADCAST_BYTES = 32 * 1024 * 1024


def build(app: str = "panelwright", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, AQE, Arrow, skew joins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **extra,
    }
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "panelwright-checkpoint"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the reliable checkpoint folder and cut its lineage; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` made and that no later step reads any more."""
    kept = df._jdf.queryExecution().logical()
    name = kept.rdd().getCheckpointFile() if kept.getClass().getSimpleName() == "LogicalRDD" else None
    if name is not None and name.isDefined():
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(name.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:
        # Estimates of many joins multiply to thousands of digits, more than an integer is read from.
        return 1 << 62


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only while its estimated size stays under ``limit``; else leave it to a shuffle join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if plan_bytes(df) <= limit else df


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, so that their workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_panelwright_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="panelwright-")
    path = os.path.join(folder, "panelwright.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    # The context copies the file and serves it to the executors.
    sc.addPyFile(path)
    sc._panelwright_shipped = True
    return spark
