"""Counting hashes by ranges: a block sends each range one packed row.

Cheaper than a row a hash where a block holds many: keys travel as arrays, and
a range's rows are counted together in numpy.  The number of ranges follows
the number of shuffle partitions, so a range's size is set as a partition's is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranges of the hash for each shuffle partition.
RANGES = 4


def range_count(df: DataFrame) -> int:
    return RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_range(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the hashes by range, bounds of each range in it)."""
    own = ((hashes >> np.uint64(32)) % np.uint64(ranges)).astype(np.uint16 if ranges < 1 << 16 else np.int64)
    return np.argsort(own, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(own, minlength=ranges))])


def held_by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """All rows of one range after another (rows come sorted by ``range``)."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["range"] != row["range"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
