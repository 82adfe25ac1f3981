"""Session helpers: a local session for tests, the shared folder, the shipped package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("topicpulse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.legacy.timeParserPolicy", "CORRECTED")
        .getOrCreate()
    )


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: on a
    cluster other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if _own_folder:
        return _own_folder[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    _own_folder.append(tempfile.mkdtemp(prefix="topicpulse-"))
    return _own_folder[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh output folder inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts the lineage like a checkpoint, and the written table also brings its size
    to the planner, so later joins pick their strategy from facts.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_topicpulse_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="topicpulse-py-"), "topicpulse.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._topicpulse_shipped = True


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spread heavy per-row work when fewer files than cores feed it.

    Large inputs have more files than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, key)
