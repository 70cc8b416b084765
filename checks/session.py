"""Local session for tests, checks and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def share_package() -> None:
    """Let Python workers of a local session find this package from any folder. A
    cluster gets it as a wheel or with --py-files; see the README."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def session(cores: str | None = None) -> SparkSession:
    share_package()
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("phrasestream")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        # Rows here cost much more to work on than to move: do not fold small
        # shuffles into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark
