"""Running sums inside each key, without gathering a key's rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelhouse.llm.common import tidy, written

#: Sums are taken modulo this; amounts lie below it.
MODULUS = 1 << 60
_MASK = np.uint64(MODULUS - 1)


def running_sums(df: DataFrame, key: str, order: list[Column], amounts: list[str], name: str) -> DataFrame:
    """``df`` with ``<amount>_sum`` for each amount: its sum up to this row among the rows of the same ``key``.

    ``key`` is a long without nulls.  Rows are range-sorted by key and order, so
    a key with very many rows spreads over tasks; each task adds up its own
    rows, and one row a task (broadcast, bounded by the number of tasks)
    carries the sum of a key that began in an earlier task.  Rows that tie in
    ``order`` must be interchangeable; they too are spread.  The sorted rows
    are written, so that a lost executor cannot move them.
    """
    at_key, at_amounts = df.columns.index(key), [df.columns.index(a) for a in amounts]
    sums = [f"{a}_sum" for a in amounts]
    names = [*df.columns, "_part", "_open", "_head", *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, last = TaskContext.get().partitionId(), None, None
        carry, opened = [np.uint64(0)] * len(amounts), True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at_key).to_numpy(zero_copy_only=False)
            new = np.zeros(n, bool)
            new[0] = last is not None and keys[0] != last
            new[1:] = keys[1:] != keys[:-1]
            starts, segment = np.flatnonzero(new), np.cumsum(new)
            found = []
            for k, at in enumerate(at_amounts):
                total = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False).astype(np.uint64))
                before = np.concatenate([[np.uint64(0) - carry[k]], np.where(starts > 0, total[starts - 1], np.uint64(0))])
                own = (total - before[segment]) & _MASK
                carry[k] = own[-1]
                found.append(pa.array(own.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array((segment == 0) & opened),
                 pa.nulls(n, pa.int64()), *found], names)
            opened = opened and not len(starts)
            head, last = int(keys[0]) if head is None else head, keys[-1]
        if head is not None:  # what this task's last key has come to
            empty = [pa.nulls(1, f.type) for f in batch.schema]
            empty[at_key] = pa.array([int(last)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.array([part], pa.int32()), pa.array([False]), pa.array([head], pa.int64()),
                 *[pa.array([int(c)], pa.int64()) for c in carry]], names)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    longs = ", ".join(f"`{s}` bigint" for s in sums)
    ordered = [F.col(key), *order, F.col("_tie")]
    rows = written(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*ordered)
                   .sortWithinPartitions(*ordered).drop("_tie")
                   .mapInArrow(tidy(run), f"{kind}, _part int, _open boolean, _head bigint, {longs}"), name)
    tails = rows.where("_head is not null")
    marks = tails.select(F.col(key).alias("_key"), "_part", F.lit(1).alias("_end"), *sums).union(
        tails.select("_head", "_part", F.lit(0), *[F.lit(0).cast("long") for _ in sums]))
    earlier = Window.partitionBy("_key").orderBy("_part", "_end").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("_part", "_end", *[
        (F.coalesce(F.sum(F.col(s).cast("decimal(20,0)")).over(earlier), F.lit(0)) % MODULUS).cast("long").alias(f"_{s}")
        for s in sums]).where("_end = 0").drop("_end")
    full = rows.where("_head is null").join(F.broadcast(carried), "_part")  # one row a task of the sort
    return full.withColumns({s: (F.col(s) + F.when(F.col("_open"), F.col(f"_{s}")).otherwise(0)).bitwiseAND(
        F.lit(MODULUS - 1)) for s in sums}).drop("_part", "_open", "_head", *[f"_{s}" for s in sums])
