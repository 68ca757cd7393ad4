"""Session settings; on a cluster the submitter's settings win."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "sieveline", cores: int = 8, shuffle: int = 8) -> SparkSession:
    """A session in one process, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", str(shuffle))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable. The folder is the cluster's spark.checkpoint.dir; only where that is unset
    and the master is local, a temporary one is made: executors of a cluster would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sieveline-"))


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared checkpoint folder, so that a lost executor costs no recomputation behind it."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
