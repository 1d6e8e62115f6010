"""Enough tasks for work that is heavy per row, when the input comes in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A large input already has more splits than cores and passes unchanged. Select the
    needed columns first, since a repartition moves all of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
