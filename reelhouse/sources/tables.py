"""Reading the given tables and library snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from reelhouse.schema import LIBRARY_SCHEMA

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Declared schemas of the given tables this library reads: a scan with a
# declared schema plans without opening a file footer (no inference job) and
# fails loudly on drift.  Tables not listed are read with inference.
GIVEN_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; Catalyst prunes columns and pushes filters into the scan."""
    path = table_path(sf_dir, name)
    reader = spark.read.schema(GIVEN_SCHEMAS[name]) if name in GIVEN_SCHEMAS else spark.read
    return reader.parquet(path)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Library scan with the fixed schema (no inference, no schema drift)."""
    return spark.read.schema(LIBRARY_SCHEMA).parquet(path)
