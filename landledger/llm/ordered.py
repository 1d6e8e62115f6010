"""Places of rows within their group's order, however much of the table one group holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from landledger.llm.shared import staged


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df and `place`: the row's place in its group from 0, under a total order. The group column has no nulls.

    The table is sorted by range, so a large group lies in several neighbouring partitions. Rows are counted along each
    partition; only groups that go on from one partition into the next, at most one for each, get a shift afterwards.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_opens", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done, opening = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(group))
            values, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            goes_on = values[0] == last
            local = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
            local[: ends[0]] += done if goes_on else 0
            opens = np.zeros(batch.num_rows, bool)
            opening = opening and (last is None or goes_on)
            opens[: ends[0]] = opening
            opening = opening and len(values) == 1
            done, last = int(local[-1]) + 1, values[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(local, pa.int64()), pa.array(opens)], [*batch.schema.names, "_part", "_local", "_opens"])

    keys = [F.col(group).asc(), *order]
    counted, _ = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count, schema), name)
    crossing = counted.where("_opens").select(group).distinct()  # at most one row a partition, as are the shifts
    sizes = counted.join(F.broadcast(crossing), group).groupBy(group, "_part").agg((F.max("_local") + 1).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.withColumn("_shift", before).where("_shift > 0").drop("_size")
    shifts = spark.createDataFrame(shifts.toArrow(), shifts.schema)
    placed = counted.join(F.broadcast(shifts), [group, "_part"], "left")
    return placed.select(*df.columns, (F.col("_local") + F.coalesce("_shift", F.lit(0))).alias("place"))


def group_key(column: Column) -> Column:
    """A text that stands for a value, with a text of its own for null that sorts first."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))
