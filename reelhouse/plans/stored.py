"""Queries over the bucketed library: updates, imports, races, snapshots and pruned reads on stored versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelhouse.operators import ingest as I
from reelhouse.operators import store as ST
from reelhouse.operators.joins import stable
from reelhouse.plans import jobs as J
from reelhouse.plans.enrich import RENAMES
from reelhouse.plans.maintenance import CFG
from reelhouse.plans.registry import query
from reelhouse.session import checkpoint_dir
from reelhouse.sources import fixtures as X
from reelhouse.sources.tables import read_table
from reelhouse.streaming import incremental as INC

#: Ids a bucket: the derived libraries fill some tens of buckets.
BUCKET_ROWS = 500
#: The stream's cards come in two drops; the later one holds the pages after this one.
EARLY_PAGES = 15


def _stored(spark, sf_dir):
    """The derived library as a stored one."""
    root = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex[:12]}"
    ST.create(X.library(spark, sf_dir), root, bucket_rows=BUCKET_ROWS, link_buckets=32)
    return root


def _labels(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


def _new_items(spark, sf_dir, root):
    cards = stable(I.first_cards(X.feed(spark, sf_dir), X.MEDIA_BASE))  # read by the index look-up and by what follows
    fresh = ST.unknown(spark, root, ST.open_version(spark, root), cards).drop("link")
    return stable(I.with_length(I.clean_cards(fresh, X.AS_OF, X.MEDIA_BASE)))


@query("update_stored")
def update_stored(spark, sf_dir):
    """Two updates of labelled ids, copy-on-write, read back."""
    root = _stored(spark, sf_dir)
    lab = _labels(spark, sf_dir)
    ST.update(lab.select("id", F.when(F.col("quality") == 1, "reviewed").alias("summary"),
                         F.concat(F.lit("- toxic "), F.col("toxic").cast("string")).alias("themes")), ["summary", "themes"], root)
    empty = F.lit(None).cast("string")
    ST.update(lab.where(F.col("id") % 3 == 0).select("id", empty.alias("summary"), empty.alias("themes")), ["summary", "themes"], root)
    return ST.read(spark, root).select("id", "summary", "themes", "category")


@query("append_stored")
def append_stored(spark, sf_dir):
    """The feed's new items appended to the stored library, all columns of the new rows."""
    root = _stored(spark, sf_dir)
    last = ST.open_version(spark, root).max_id
    ok, _ = I.split_rejects(_new_items(spark, sf_dir, root))
    ST.append(ok, root, X.AS_OF)
    return ST.read(spark, root).where(F.col("id") > last)


@query("publish_race")
def publish_race(spark, sf_dir):
    """Two writers start from one version; the second finds its number taken and builds anew.

    The first stores the items at even positions, the second all of them.  Both
    are named runs, which make a version even if the feed has nothing new.
    """
    root = _stored(spark, sf_dir)
    last = ST.open_version(spark, root).max_id
    items, _ = I.split_rejects(_new_items(spark, sf_dir, root))
    items, base = stable(items), ST.open_version(spark, root)
    ST.append(items.where(F.col("pos") % 2 == 0), root, X.AS_OF, run="even")
    assert ST.open_version(spark, root).version == base.version + 1
    assert not ST.try_commit(spark, root, base)  # the number after the common base is taken
    ST.append(items, root, X.AS_OF, run="all")
    return ST.read(spark, root).where(F.col("id") > last).select("id", "link", "title")


@query("category_counts_stored")
def category_counts_stored(spark, sf_dir):
    """Counts kept up to date by an import, hidden flags and renames."""
    root = _stored(spark, sf_dir)
    ok, _ = I.split_rejects(_new_items(spark, sf_dir, root))
    ST.append(ok.withColumn("category", F.when(F.col("pos") % 3 == 0, "cat_new").otherwise("cat_fr")), root, X.AS_OF)
    ST.set_hidden(_labels(spark, sf_dir).select("id", (F.col("quality") == 0).alias("hidden")), root)
    ST.rename_categories(spark, root, RENAMES)
    return ST.category_counts(spark, root)


@query("library_top50_stored")
def library_top50_stored(spark, sf_dir):
    return ST.newest(spark, _stored(spark, sf_dir)).select("id", "title", "link", "channel", "category", "progress", "length_seconds")


@query("library_top50_category_stored")
def library_top50_category_stored(spark, sf_dir):
    return ST.newest(spark, _stored(spark, sf_dir), category="cat_fr").select("id", "title", "link", "category")


@query("lookup_links_stored")
def lookup_links_stored(spark, sf_dir):
    return ST.lookup(spark, _stored(spark, sf_dir), _labels(spark, sf_dir).where("quality = 0"))


@query("snapshots_by_reference")
def snapshots_by_reference(spark, sf_dir):
    """Seven days of snapshots, a change a day; the five kept ones are whole after old folders went."""
    root = _stored(spark, sf_dir)
    lab = stable(_labels(spark, sf_dir))
    for day in range(1, 8):
        if day > 1:
            ST.set_hidden(lab.where(F.col("id") % 7 == day - 1).select("id", F.lit(True).alias("hidden")), root)
        ST.snapshot(spark, root, f"2024-02-{day:02d} 06:00:00")
    ST.vacuum(spark, root, grace_seconds=0)
    parts = [ST.read_snapshot(spark, root, d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hidden").cast("bigint")).alias("hidden"))
             .withColumn("snapshot_date", F.lit(d)) for d in ST.snapshots(spark, root)]  # five dates
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _imported(spark, sf_dir):
    root = _stored(spark, sf_dir)
    for run in ("first", "second", "second"):  # a run that is started again changes nothing
        J.import_stored(X.feed_pages(spark, sf_dir), root, X.captions(spark, sf_dir), X.AS_OF, run, CFG)
    return root


@query("import_stored")
def import_stored(spark, sf_dir):
    """Stored pages to the stored library, in stages, twice (the second run adds nothing)."""
    return ST.read(spark, _imported(spark, sf_dir)).select(
        "id", "link", "title", "category", F.sha2(F.coalesce("summary", F.lit("")), 256).alias("summary_hash"))


@query("ingest_rejects_stored")
def ingest_rejects_stored(spark, sf_dir):
    """What two imports could not store, with the attempts."""
    return ST.rejects(spark, _imported(spark, sf_dir)).select("link", "stage", "attempts", "problem")


@query("stream_import")
def stream_import(spark, sf_dir):
    """Cards arriving in two drops, each imported by the stream; all columns of the new rows."""
    root = _stored(spark, sf_dir)
    last, feed = ST.open_version(spark, root).max_id, X.feed(spark, sf_dir)
    for drop in (feed.where(F.col("page_id") <= EARLY_PAGES), feed.where(F.col("page_id") > EARLY_PAGES)):
        INC.stage_cards(drop, f"{root}/cards")
        INC.run_stored_import(spark, f"{root}/cards", root, f"{root}/checkpoint", X.AS_OF, X.MEDIA_BASE)
    return ST.read(spark, root).where(F.col("id") > last)
