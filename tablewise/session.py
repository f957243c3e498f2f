"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    parts = str(os.cpu_count() or 8) if cores == "*" else cores
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("tablewise")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablewise-"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folder: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tablewise-"))
    return _own_folder[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a shared intermediate as Parquet in the work folder and read it back.

    This cuts the lineage, survives lost executors, and lets each reader prune
    columns and push filters of its own.
    """
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete stored intermediates that no later plan reads; frames of other origin are left alone."""
    for frame in frames:
        path = getattr(frame, "_stored_at", None) if "_stored_at" in vars(frame) else None
        if path:
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
