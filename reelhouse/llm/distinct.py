"""Distinct contents by digest, with the copies taken out before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from reelhouse.llm.common import tidy


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def distinct_contents(rows: DataFrame) -> DataFrame:
    """One row for each value of the first column, a binary digest.

    Every task first drops the copies it holds, so a group of copies, however
    large, sends one row a task into the shuffle.  A task remembers the digests
    of its own partition only.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    own = rows.mapInArrow(tidy(_first_of_each), kind)
    return own.repartition(own.columns[0]).mapInArrow(tidy(_first_of_each), kind)
