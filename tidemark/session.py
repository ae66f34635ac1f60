"""A local session for tests and benchmarks; on a cluster the session is given."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place below the folder that spark.checkpoint.dir names, which driver and executors share; on one machine without it a temporary one."""
    base = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='tidemark-')}/{name}-{uuid.uuid4().hex}"
