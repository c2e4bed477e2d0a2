"""Cutting lineage where a result is read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where a result is read twice and must not change between reads
    (generated ids, model answers): a lost executor then re-reads the
    checkpoint instead of recomputing a different value.
    """
    return df.checkpoint(eager=True)
