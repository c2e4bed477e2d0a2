"""Home view, category picker and work-queue queries (L6, P*, A1, A2, T1, T2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelhouse.operators import library as L
from reelhouse.plans.registry import query
from reelhouse.schema import validate_library
from reelhouse.sources import fixtures as X
from reelhouse.sources.tables import read_table


@query("category_counts")
def category_counts(spark, sf_dir):
    return L.category_counts(X.library(spark, sf_dir))


@query("library_top50")
def library_top50(spark, sf_dir):
    return L.library_top(X.library(spark, sf_dir)).select(
        "id", "title", "link", "channel", "category", "progress", "length_seconds")


@query("library_top50_category")
def library_top50_category(spark, sf_dir):
    return L.library_top(X.library(spark, sf_dir), "cat_fr").select(
        "id", "title", "link", "category")


@query("library_view")
def library_view(spark, sf_dir):
    return L.library_view(X.library(spark, sf_dir), None, X.AS_OF)


@query("distinct_categories")
def distinct_categories(spark, sf_dir):
    return L.distinct_categories(X.library(spark, sf_dir))


@query("queue_subtitles")
def queue_subtitles(spark, sf_dir):
    return L.queue_subtitles(X.library(spark, sf_dir)).select("id", "link")


@query("queue_themes")
def queue_themes(spark, sf_dir):
    return L.queue_themes(X.library(spark, sf_dir)).select("id", "title")


@query("queue_summaries")
def queue_summaries(spark, sf_dir):
    return L.queue_summaries(X.library(spark, sf_dir)).select(
        "id", F.length("subtitles").cast("bigint").alias("subtitle_chars"))


@query("lookup_links")
def lookup_links(spark, sf_dir):
    ids = read_table(spark, sf_dir, "labels").where(F.col("quality") == 0).select(F.col("doc_id").alias("id"))
    return L.lookup(X.library(spark, sf_dir), ids)


@query("validate_library")
def validate_library_q(spark, sf_dir):
    """A library with missing titles and links stored twice."""
    lib = X.library(spark, sf_dir)
    torn = lib.withColumn("title", F.when(F.col("id") % 10 == 3, F.lit(None)).otherwise(F.col("title")))
    return validate_library(torn.unionByName(lib.where(F.col("id") % 7 == 0)))


@query("queue_subtitles_retry")
def queue_subtitles_retry(spark, sf_dir):
    """The transcript queue after one failed try of every third item."""
    lib = X.library(spark, sf_dir)
    return L.queue_subtitles(lib, lib.where(F.col("id") % 3 == 0).select("id")).select("id", "link")
