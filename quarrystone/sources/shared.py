"""The folder that all executors share: checkpoints and tables that a job writes for itself."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only where that is unset and the session is a single local JVM, as in tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
    if not own.isDefined():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quarrystone/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """A path of shared_path that nothing reads any more."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None and spark.sparkContext._jsc is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, without their lineage: a lost executor doesn't lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
