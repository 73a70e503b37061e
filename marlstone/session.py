"""Session settings, the shared scratch folder and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own; a caller's session keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, **more: str) -> SparkSession:
    """A local session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("marlstone")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g", **more}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each Spark application, so that Python
    operators don't depend on what is installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / "marlstone.zip"  # read by the driver's file server only
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._marlstone_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a session on one machine (tests) gets a temporary one; on a
    cluster that is an error, since every executor would write to a folder of its own."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        to = os.path.join(tempfile.gettempdir(), "marlstone-checkpoint")
    sc.setCheckpointDir(to)
    return to


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small input in one file would else keep one core busy.

    Larger inputs come in more partitions and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared scratch folder and read again: later reads
    neither repeat its work nor depend on the executors that did it."""
    spark = df.sparkSession
    to = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marlstone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)
