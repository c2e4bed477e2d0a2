"""Global order with running totals, without sorting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelhouse.llm.common import tidy, written


def running(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """``df`` with ``_before``, the sum of ``amount`` over all earlier rows, and ``_at``, their number.

    Rows are range-sorted; each task numbers and sums its own, and one row a
    task (bounded by the number of tasks) carries the offsets.  The sorted rows
    are written to the shared folder, so a lost executor cannot move them.
    Rows that tie in ``order`` must be interchangeable.
    """
    at = df.columns.index(amount)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            run = np.zeros(n + 1, np.int64)
            np.cumsum(batch.column(at).to_numpy(zero_copy_only=False), out=run[1:])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(run[:-1] + total),
                 pa.array(np.arange(rows, rows + n))], [*batch.schema.names, "_part", "_before", "_at"])
            total += int(run[-1])
            rows += n

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(tidy(sums), f"{kind}, _part int, _before bigint, _at bigint"), name)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(
        F.max(F.col("_before") + F.col(amount)).alias("_sum"), F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sums"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"))
    return (rows.join(F.broadcast(offsets), "_part")  # one row a task of the sort
            .withColumns({"_before": F.col("_before") + F.col("_sums"), "_at": F.col("_at") + F.col("_rows")})
            .drop("_part", "_sums", "_rows"))
