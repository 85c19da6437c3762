"""Running totals over a whole table in a global order, without bringing rows together in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siterank.sources.staging import stage


def running(rows: DataFrame, order: list[Column], amount: str, name: str = "ranges") -> DataFrame:
    """rows with _row (0, 1, ...) and _before (the amounts, whole numbers without NULL, of all earlier rows) in the
    given order. Rows that tie in the order must be alike for the result to be the same in every run.

    The rows are range-partitioned and sorted; a task adds up its own range, and the totals of earlier ranges, one
    row for each range, are added when the written table is read. rows is read twice, once to find the ranges.
    """
    schema = T.StructType([*rows.schema, *(T.StructField(n, T.LongType()) for n in ("_range", "_row", "_before"))])
    at = rows.columns.index(amount)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if batch.num_rows:
                amounts = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(amounts)
                more = (np.full(len(upto), part, np.int64), row + np.arange(len(upto)), total + upto - amounts)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=schema.names)
                row, total = row + len(upto), total + int(upto[-1])

    ranged = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), name)
    ends = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("t"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = ends.select(
        "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_t")
    )
    return ranged.join(F.broadcast(starts), "_range").select(
        *rows.columns, (F.col("_row") + F.col("_n")).alias("_row"), (F.col("_before") + F.col("_t")).alias("_before")
    )
