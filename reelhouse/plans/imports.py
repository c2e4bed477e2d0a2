"""Field-cleaning and import queries over the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelhouse.functions import dates as D
from reelhouse.functions import fields as FF
from reelhouse.operators import ingest as I
from reelhouse.operators.joins import stable
from reelhouse.plans.registry import query
from reelhouse.sources import fixtures as X
from reelhouse.sources.tables import read_table


def _feed(spark, sf_dir):
    return X.feed(spark, sf_dir)


@query("length_normalised")
def length_normalised(spark, sf_dir):
    f = _feed(spark, sf_dir)
    return f.select("pos", FF.normalize_length(FF.badge_length("length_text")).alias("length_text"))


@query("length_seconds")
def length_seconds(spark, sf_dir):
    f = _feed(spark, sf_dir)
    n = FF.normalize_length(FF.badge_length("length_text"))
    return f.select("pos",
                    FF.length_seconds(n, "ms").alias("seconds_ms"),
                    FF.length_seconds(n, "hm").alias("seconds_hm"),
                    FF.length_problem(n).alias("problem"))


@query("progress_pct")
def progress_pct(spark, sf_dir):
    return _feed(spark, sf_dir).select("pos", FF.progress_pct("progress_style").alias("progress"))


@query("link_thumbnail")
def link_thumbnail(spark, sf_dir):
    f = _feed(spark, sf_dir)
    link = FF.canonical_link("href", X.MEDIA_BASE)
    return f.select("pos", link.alias("link"), FF.thumbnail("thumb_src", link).alias("thumbnail"))


@query("created_from_relative")
def created_from_relative(spark, sf_dir):
    f = _feed(spark, sf_dir)
    return f.select("pos", D.relative_created(I.first_date_span(F.col("meta_spans")),
                                              D.as_of_literal(X.AS_OF)).alias("video_created"))


PHRASES = ("an hour ago", "a day ago", "Yesterday", "2 hrs ago", "today", "Streamed one week ago", "3 mos ago",
           "a few minutes ago", "soon", "10yrs ago", "premieres in 2 hours", "live in 3 days", "scheduled for today", "5 days")


@query("created_phrases")
def created_phrases(spark, sf_dir):
    """Relative dates in words and short units."""
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    e = read_table(spark, sf_dir, "events")
    phrase = F.element_at(phrases, (F.col("event_id") % len(PHRASES) + 1).cast("int"))
    return e.select("event_id", D.relative_created(phrase, D.as_of_literal(X.AS_OF)).alias("video_created"))


@query("card_title")
def card_title(spark, sf_dir):
    return _feed(spark, sf_dir).select("pos", FF.title("title_attr", "title_text").alias("title"))


@query("clean_cards")
def clean_cards(spark, sf_dir):
    return I.clean_cards(_feed(spark, sf_dir), X.AS_OF, X.MEDIA_BASE)


@query("first_per_link")
def first_per_link(spark, sf_dir):
    first = I.first_cards(_feed(spark, sf_dir), X.MEDIA_BASE)
    return I.clean_cards(first.drop("link"), X.AS_OF, X.MEDIA_BASE)


@query("import_new_links")
def import_new_links(spark, sf_dir):
    items = I.new_items(_feed(spark, sf_dir), X.library(spark, sf_dir), X.AS_OF, X.MEDIA_BASE)
    return items.select("link", "page_id", "pos", "title")


@query("ingest_rejects")
def ingest_rejects(spark, sf_dir):
    items = I.new_items(_feed(spark, sf_dir), X.library(spark, sf_dir), X.AS_OF, X.MEDIA_BASE)
    _, bad = I.split_rejects(items)
    return bad.select("link", "length_text", "problem")


@query("append_items")
def append_items(spark, sf_dir):
    lib = X.library(spark, sf_dir)
    items = stable(I.new_items(_feed(spark, sf_dir), lib, X.AS_OF, X.MEDIA_BASE))  # read for the ids and the rows
    ok, _ = I.split_rejects(items)
    return I.append_items(lib, ok, X.AS_OF)
