"""Tables written once and read again: lineage ends there, and a lost executor costs a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="quireworks-"))
    return _OWN_FOLDER[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back. It is not removed; give that folder an expiry rule."""
    path = f"{shared_folder(df.sparkSession)}/quireworks/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many parts as the session has cores, if it has fewer: a file that cannot be split is one part, and what Python does to its rows would be one task. Larger inputs are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
