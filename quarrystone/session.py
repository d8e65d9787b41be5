"""Session factory with the settings every query of the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_package(spark: SparkSession) -> None:
    """Python workers look for the package where the driver has it, if it isn't installed for them."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def get_session(app: str = "quarrystone", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session unless the caller's environment already names a master."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        builder = builder.master(f"local[{n}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(max(n, 8)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    reach_package(spark)
    return spark
