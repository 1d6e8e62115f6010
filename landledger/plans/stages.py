"""Stage tables: written once to the shared folder, read by everything after.

Spark does not share work between actions. Each stage is a Parquet table, so a later
stage scans the columns it needs instead of planning and running the whole chain again,
and nothing is lost with an executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landledger.session import checkpoint_root


def _tables(spark: SparkSession, folder: str) -> list[str]:
    """Name, size and time of what lies in a folder; nothing where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in system.listStatus(path))


class Stages:
    _open: dict[tuple[str, str], "Stages"] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        digest = hashlib.sha256(name.encode()).hexdigest()[:12]
        self.root = f"{checkpoint_root(spark)}/stages/{spark.sparkContext.applicationId}/{digest}"
        self.written: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, name: str, *settings: object) -> "Stages":
        """The stages of one input under the given settings within one application.

        Where the input is a folder, its tables' sizes and times are part of the key: rewritten data has stages of its own.
        """
        name = "|".join([name, *map(repr, settings), *_tables(spark, name)])
        key = (spark.sparkContext.applicationId, name)
        if key not in cls._open:
            cls._open[key] = cls(spark, name)
        return cls._open[key]

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table that the plan reads more than once. Another plan under the same name is another table."""
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
        digest = hashlib.sha256(f"{plan}|{df.schema.json()}|{df.semanticHash()}".encode()).hexdigest()[:24]
        return self.table(f"{name}-{digest}", lambda: df)

    def drop(self) -> None:
        """Delete the written tables; frames that read them are of no use afterwards."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.written.clear()

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.written:
            df = build()
            path = f"{self.root}/{name}"
            df.write.mode("overwrite").parquet(path)
            self.written[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.written[name]
