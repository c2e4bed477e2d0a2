"""Snapshot retention, streaming import and the full import (A7, K5, ST1, L1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelhouse.functions import fields as FF
from reelhouse.operators import snapshots as S
from reelhouse.plans import jobs as J
from reelhouse.plans.enrich import CONFIGURED
from reelhouse.plans.registry import query
from reelhouse.schema import LIBRARY_SCHEMA
from reelhouse.session import checkpoint_dir
from reelhouse.sources import fixtures as X
from reelhouse.sources import html_cards as H
from reelhouse.sources.tables import read_table
from reelhouse.streaming import incremental as ST


@query("snapshot_retention")
def snapshot_retention(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    manifest = e.select(FF.date_stamp("ts").alias("snapshot_date"))
    return S.expired_snapshots(manifest)


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("stream_import_links")
def stream_import_links(spark, sf_dir):
    base = _scratch(spark, "stream")
    ST.stage_cards(X.feed(spark, sf_dir), f"{base}/cards")
    ST.run_import(spark, f"{base}/cards", X.library(spark, sf_dir), f"{base}/out",
                  f"{base}/checkpoint", X.AS_OF, X.MEDIA_BASE, files_per_batch=4)
    return ST.read_output(spark, f"{base}/out").select("link")


@query("snapshot_publish")
def snapshot_publish(spark, sf_dir):
    """Publish the library as a new version, snapshot it, read the latest back."""
    root = _scratch(spark, "library")
    lib = X.library(spark, sf_dir)
    S.publish(lib, f"{root}/versions")
    S.snapshot(S.read_latest(spark, f"{root}/versions"), f"{root}/snapshots", X.AS_OF)
    snap = spark.read.parquet(f"{root}/snapshots")
    return snap.groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("n"),
                                             F.sum(F.col("hidden").cast("bigint")).alias("hidden"))


CFG = J.ImportConfig(categories=CONFIGURED, site_base=X.MEDIA_BASE)


@query("ingest_full")
def ingest_full(spark, sf_dir):
    rows, _ = J.ingest(X.feed(spark, sf_dir), X.library(spark, sf_dir), X.captions(spark, sf_dir),
                       X.AS_OF, CFG)
    return rows.select("id", "link", "title", "length_seconds", "video_created",
                       F.sha2(F.coalesce("subtitles", F.lit("")), 256).alias("subtitle_hash"),
                       "summary", "category")


@query("ingest_pages")
def ingest_pages(spark, sf_dir):
    """Pages to a stored library, twice (the second run adds nothing), read back."""
    root = _scratch(spark, "imported")
    S.publish(X.library(spark, sf_dir), root)
    for _ in range(2):
        J.import_pages(X.feed_pages(spark, sf_dir), root, X.captions(spark, sf_dir), X.AS_OF, CFG)
    out = S.read_latest(spark, root, LIBRARY_SCHEMA)
    return out.select("id", "link", "title", "category", F.sha2(F.coalesce("summary", F.lit("")), 256).alias("summary_hash"))


@query("backfill_summaries")
def backfill_summaries(spark, sf_dir):
    lib = J.backfill_summaries(X.library(spark, sf_dir), CFG, reset_unused=True)
    return lib.select("id", "summary", "themes", "blurb")


@query("retry_summaries")
def retry_summaries(spark, sf_dir):
    ids = read_table(spark, sf_dir, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return J.retry_summaries(X.library(spark, sf_dir), ids, CFG).select("id", "summary")


@query("cards_found")
def cards_found(spark, sf_dir):
    return H.card_counts(X.feed_pages(spark, sf_dir)).where("cards > 0")
