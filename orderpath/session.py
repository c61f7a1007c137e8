"""Shared storage used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such a
    folder would vanish with the machine that holds it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="orderpath-")
    context.setCheckpointDir(folder)
    return folder


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of the written table.

    Used where a plan is read more than once and recomputing it would be costly or
    would not give the same row placement. The table outlives lost executors, and
    being columnar it still allows column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orderpath/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
