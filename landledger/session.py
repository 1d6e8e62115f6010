"""Session settings the jobs rely on, and the folder long lineages are cut into."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "landledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def kernel_partitions(spark: SparkSession) -> int:
    """Tasks for a step that computes much per byte; adaptive coalescing would go by bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only on a local master, where all tasks see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master or 'the cluster'} share")
    root = tempfile.mkdtemp(prefix="landledger-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()
