"""The library table: fixed schema, constraints and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One row per stored item; ``link`` is unique.
LIBRARY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("link", T.StringType(), False),
    T.StructField("channel", T.StringType(), True),
    T.StructField("thumbnail", T.StringType(), True),
    T.StructField("subtitles", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("blurb", T.StringType(), True),
    T.StructField("themes", T.StringType(), True),
    T.StructField("progress", T.IntegerType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("video_created", T.TimestampNTZType(), True),
    T.StructField("length_seconds", T.LongType(), True),
    T.StructField("record_created", T.TimestampNTZType(), False),
    T.StructField("hidden", T.BooleanType(), False),
])

LIBRARY_COLUMNS = [f.name for f in LIBRARY_SCHEMA.fields]
NOT_NULL = [f.name for f in LIBRARY_SCHEMA.fields if not f.nullable]

# Raw feed card as the extractor emits it: strings only, cleaning comes later.
CARD_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("href", T.StringType()),
    T.StructField("title_attr", T.StringType()),
    T.StructField("title_text", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("thumb_src", T.StringType()),
    T.StructField("length_text", T.StringType()),
    T.StructField("progress_style", T.StringType()),
    T.StructField("meta_spans", T.ArrayType(T.StringType())),
    T.StructField("is_ad", T.BooleanType()),
    T.StructField("is_sponsored", T.BooleanType()),
    T.StructField("is_collection", T.BooleanType()),
])


def conform(df: DataFrame) -> DataFrame:
    """Select and cast to the library schema, in schema order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in LIBRARY_SCHEMA.fields])


def validate_library(library: DataFrame) -> DataFrame:
    """Constraint report: one row per violated rule with its row count.

    Checks NOT NULL columns and link uniqueness in a single aggregation pass
    plus one grouped count on ``link`` (partially aggregated before the
    shuffle, so a link repeated a million times costs one row per task).
    """
    null_counts = library.agg(*[
        F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in NOT_NULL
    ])
    nulls = null_counts.select(F.explode(F.array(*[
        F.struct(F.lit(f"{c} is null").alias("rule"), F.coalesce(F.col(c), F.lit(0)).alias("rows"))
        for c in NOT_NULL
    ])).alias("r")).select("r.*")
    dups = (library.groupBy("link").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
            .select(F.lit("link is not unique").alias("rule"), F.col("rows").cast("bigint")))
    return nulls.unionByName(dups).where("rows > 0")
