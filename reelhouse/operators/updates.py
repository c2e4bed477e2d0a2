"""Column updates as DataFrame transformations.

Parquet files are immutable; an update is a left join of the library with a
change set on ``id`` that yields the new library, written to a new version.
A matched change always wins, even when its value is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_changes(changes: DataFrame, cols: list[str], order: str | None) -> DataFrame:
    """One change per ``id``: the last by the ``order`` column.

    The winning order is found by a hash aggregate (combined map side); the
    values are joined to it.  Without an order column every id may occur once
    only; a second change of an id then ends the job with an error instead of
    one of them being dropped silently.
    """
    if order is None:
        once = changes.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols])
        fail = F.raise_error(F.concat(F.lit("several changes without an order column for id "), F.col("id").cast("string")))
        return once.select("id", *cols, F.when(F.col("_n") > 1, fail.cast("int")).otherwise(F.lit(1)).alias("_one"))
    last = changes.groupBy("id").agg(F.max(order).alias(order))
    ties = changes.join(last, ["id", order], "left_semi").dropDuplicates(["id", order])
    return ties.select("id", *cols, F.lit(1).alias("_one"))


def apply_updates(library: DataFrame, changes: DataFrame, cols: list[str], order: str | None = None,
                  sent: bool = False) -> DataFrame:
    """K2: set ``cols`` from ``changes`` (keyed by ``id``) on matching rows.

    ``order`` names the column that tells which change of an id came last.
    ``sent``: the changes are known to be few and go to where the rows are read.
    """
    one = last_changes(changes, cols, order)
    ch = one.select(F.col("id").alias("_cid"), "_one", *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = library.join(F.broadcast(ch) if sent else ch, library["id"] == ch["_cid"], "left")
    matched = F.col("_one") == 1
    return joined.select(*[F.when(matched, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                           for c in library.columns])


def set_hidden(library: DataFrame, flags: DataFrame, order: str | None = None) -> DataFrame:
    """K3: set the hidden flag of the given ids; the last flag of an id wins."""
    return apply_updates(library, flags, ["hidden"], order)
