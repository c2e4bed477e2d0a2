"""Library, feed, captions and model-answer tables derived from the given data.

The given parquet tables (documents, labels, events, conversations, pages)
are shaped into the tables this library works on.  Every derived table grows
with its source, so each query's work scales with the scale factor.  The same
derivations are written as SQL in :mod:`reelhouse.plans.oracle` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse.functions import fields as FF
from reelhouse.functions.dates import as_of_literal
from reelhouse.schema import conform
from reelhouse.sources.tables import read_table

# Parameters of the derived tables.
AS_OF = "2024-02-01 00:00:00"
MEDIA_BASE = "https://media.example"
WATCH_PREFIX = MEDIA_BASE + "/watch?v="
FEED_LINK_STRIDE = 10     # feed video key = user_id * stride; about 1/3 are new
CAPTION_LINK_STRIDE = 15  # caption video key = conv_id * stride (meets library and feed)
FIRST_SENTENCE = r"^[^.!?]*[.!?]?"


def library(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Stored library: one item per document, hidden when labelled toxic."""
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    k = F.col("doc_id")
    link = F.concat(F.lit(WATCH_PREFIX), k.cast("string"))
    length_text = (F.when(k % 6 == 0, "5:30").when(k % 6 == 1, "1:23:45")
                    .when(k % 6 == 2, "SHORTS").when(k % 6 == 3, F.lit(None))
                    .when(k % 6 == 4, "12:07").otherwise("5:75"))
    ts = as_of_literal(as_of)
    out = d.join(lab, "doc_id", "left").select(
        k.alias("id"),
        F.substring("text", 1, 40).alias("title"),
        link.alias("link"),
        F.col("source").alias("channel"),
        FF.thumbnail(F.lit(None).cast("string"), link).alias("thumbnail"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("text")).alias("subtitles"),
        F.when((k % 5 == 0) | (k % 3 == 0), F.lit(None))
         .otherwise(F.regexp_extract("text", FIRST_SENTENCE, 0)).alias("summary"),
        F.lit(None).cast("string").alias("blurb"),
        F.when(k % 4 == 0, F.lit(None))
         .otherwise(F.concat(F.lit("- "), F.col("lang"), F.lit("\n- "), F.col("source"))).alias("themes"),
        (k % 101).cast("int").alias("progress"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("cat_"), F.col("lang"))).alias("category"),
        F.timestamp_add("SECOND", -((k * 4099) % 40000000), ts).alias("video_created"),
        FF.length_seconds(FF.normalize_length(length_text)).alias("length_seconds"),
        ts.alias("record_created"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("hidden"),
    )
    return conform(out)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed cards (extractor schema), many cards per link.

    One card per event; a card's page is the event's day, its position the
    event id, so (page_id, pos) is the feed order.
    """
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    vid = (F.col("user_id") * FEED_LINK_STRIDE).cast("string")
    href = (F.when(k % 97 == 0, F.lit(""))
             .when(k % 2 == 0, F.concat(F.lit("/watch?v="), vid, F.lit("&t="), k.cast("string")))
             .otherwise(F.concat(F.lit(WATCH_PREFIX), vid, F.lit("&t="), k.cast("string"))))
    secs = F.floor("value").cast("bigint")
    mmss = F.concat((F.floor(F.col("value") / 60).cast("bigint") % 100).cast("string"), F.lit(":"),
                    F.lpad((secs % 60).cast("string"), 2, "0"))
    length_text = (F.when(k % 7 == 0, "LIVE").when(k % 7 == 1, "upcoming")
                    .when(k % 7 == 2, "5:75").when(k % 7 == 3, "1:02:03")
                    .when(k % 7 == 4, " 4:05 ").when(k % 7 == 5, "SHORTS").otherwise(mmss))
    unit = (F.when(k % 6 == 0, "minutes").when(k % 6 == 1, "hours").when(k % 6 == 2, "days")
             .when(k % 6 == 3, "weeks").when(k % 6 == 4, "months").otherwise("years"))
    created_text = F.concat((1 + k % 11).cast("string"), F.lit(" "), unit, F.lit(" ago"))
    views = F.concat(secs.cast("string"), F.lit(" views"))
    spans = F.when(k % 13 == 0, F.array(views)).otherwise(F.array(views, created_text))
    style = (F.when(k % 4 == 0, "width: 61%;").when(k % 4 == 1, "width:7%")
              .when(k % 4 == 2, "width: 61.5%").otherwise(F.lit(None)))
    return e.select(
        (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1)
        .cast("bigint").alias("page_id"),
        k.alias("pos"),
        href.alias("href"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Video "), vid)).alias("title_attr"),
        F.concat(F.lit(" Video "), vid, F.lit(" ")).alias("title_text"),
        F.col("event_type").alias("channel"),
        F.when(k % 2 == 0, F.lit(None))
         .otherwise(F.concat(F.lit(MEDIA_BASE + "/img/"), vid, F.lit(".jpg"))).alias("thumb_src"),
        length_text.alias("length_text"),
        style.alias("progress_style"),
        spans.alias("meta_spans"),
        (k % 50 == 7).alias("is_ad"),
        (k % 50 == 8).alias("is_sponsored"),
        (k % 50 == 9).alias("is_collection"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption tracks per link: nested JSON built from a conversation's turns.

    Even conversations start with an event that has no ``segs``.
    """
    c = read_table(spark, sf_dir, "conversations")
    per_conv = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    events = F.transform("turns", lambda t: F.struct(
        F.array(F.struct(t["text"].alias("utf8"))).alias("segs")))
    empty = F.array(F.struct(F.lit(None).cast("array<struct<utf8:string>>").alias("segs")))
    events = F.when(F.col("conv_id") % 2 == 0, F.concat(empty, events)).otherwise(events)
    return per_conv.select(
        F.concat(F.lit(WATCH_PREFIX), (F.col("conv_id") * CAPTION_LINK_STRIDE).cast("string")).alias("link"),
        F.when(F.col("conv_id") % 4 == 3, F.lit("en")).otherwise(F.lit("a.en")).alias("track"),
        F.to_json(F.struct(events.alias("events"))).alias("json"),
    )


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers (assistant turns), some with a "Here is" preamble."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    k = F.col("conv_id")
    answer = (F.when(k % 3 == 0, F.concat(F.lit("Here is a summary:\n\n"), F.col("text")))
               .when(k % 3 == 1, F.concat(F.lit("Here are notes\n"), F.col("text"), F.lit("\n")))
               .otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" \n"))))
    return c.select(k.alias("id"), F.col("turn").alias("chunk"), answer.alias("response"))


def category_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw free-form category answers, one per document, in several shapes."""
    d = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    name = F.concat(F.lit("cat_"), F.col("lang"))
    answer = (F.when(k % 5 == 0, F.concat(F.lit("Category: **"), name, F.lit("** fits")))
               .when(k % 5 == 1, F.concat(F.lit(" "), name, F.lit("\n")))
               .when(k % 5 == 2, F.concat(F.lit("The best one is "), name))
               .when(k % 5 == 3, F.concat(F.lit('"'), name, F.lit('"')))
               .otherwise(F.concat(F.lit("*"), F.upper(name), F.lit("*"))))
    return d.select(k.alias("id"), answer.alias("answer"))


PATTERNS = ("AC\\DC", "cat\\", "%", "cat\\_en", "c_t\\_FR", "______", "_", "c%\\n", "zz%", "C%_d%")


def pattern_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that read as patterns, with escapes and wildcards, one for every document."""
    d = read_table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(p) for p in PATTERNS])
    return d.select((-F.col("doc_id") - 1).alias("id"),
                    F.element_at(names, (F.col("doc_id") % len(PATTERNS)).cast("int") + 1).alias("category"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every item."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _esc(c):
    """HTML-escape text or an attribute value."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


CARDS_PER_PAGE = 100


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed rendered back to HTML pages of ``CARDS_PER_PAGE`` cards.

    Round-trip input for the card extractor: one page per hundred events, in
    event order.  A page is a bounded group (at most a hundred cards).  Every
    eleventh card has a title link without ``href`` in front of its image
    link, so the first-match rule drops it.  Before every thirteenth card stands
    the same card in a comment and a script that mentions one; every
    seventeenth card's tag is in upper case.
    """
    f = feed(spark, sf_dir)
    k = F.col("pos")
    cls = lambda name: F.lit(f' class="{name}"')
    opt = lambda cond, html: F.when(cond, html).otherwise(F.lit(""))
    spans = F.array_join(F.transform("meta_spans", lambda s: F.concat(
        F.lit('<span class="yt-content-metadata-view-model__metadata-text">'), _esc(s), F.lit("</span>"))), "")
    card = F.concat(
        opt(k % 13 == 0, F.lit('<!-- <ytd-rich-item-renderer><a id="thumbnail" href="/x"></a> --><script>"<ytd-rich-item-renderer>"</script>')),
        F.when(k % 17 == 0, F.lit("<YTD-Rich-Item-Renderer>")).otherwise(F.lit("<ytd-rich-item-renderer>")),
        F.lit("<div id=\"content\">"),
        opt(F.col("is_ad"), F.lit("<ytd-ad-slot-renderer></ytd-ad-slot-renderer>")),
        opt(F.col("is_sponsored"), F.lit("<p><span>Sponsored</span></p>")),
        opt(k % 50 == 10, F.lit("<p><span>Sponsored by Acme</span></p>")),
        opt(F.col("is_collection"), F.lit('<div class="ytCollectionsStackCollectionStack2"></div>')),
        F.lit("<a"), cls("yt-lockup-view-model__content-image"),
        F.lit(' href="'), _esc(F.col("href")), F.lit('"><div'), cls("ytThumbnailViewModelImage"), F.lit(">"),
        opt(F.col("thumb_src").isNotNull(), F.concat(F.lit('<img src="'), _esc(F.col("thumb_src")), F.lit('">'))),
        F.lit("</div><yt-thumbnail-badge-view-model><div"), cls("yt-badge-shape__text"), F.lit(">"),
        _esc(F.col("length_text")), F.lit("</div></yt-thumbnail-badge-view-model>"),
        opt(F.col("progress_style").isNotNull(), F.concat(
            F.lit("<div"), cls("ytThumbnailOverlayProgressBarHostWatchedProgressBarSegment"),
            F.lit(' style="'), _esc(F.col("progress_style")), F.lit('"></div>'))),
        F.lit("</a>"),
        opt(k % 11 == 0, F.concat(F.lit("<a"), cls("yt-lockup-metadata-view-model__title"), F.lit(">"))),
        F.lit("<h3"), cls("yt-lockup-metadata-view-model__heading-reset"),
        F.concat(F.lit(' title="'), _esc(F.col("title_attr")), F.lit('"')),
        F.lit(">"), _esc(F.col("title_text")), F.lit("</h3>"),
        opt(k % 11 == 0, F.lit("</a>")),
        F.lit("<div"), cls("yt-content-metadata-view-model__metadata-row"), F.lit('><a href="/c">'),
        _esc(F.col("channel")), F.lit("</a></div>"),
        F.lit("<div"), cls("yt-content-metadata-view-model__metadata-row"), F.lit(">"), spans, F.lit("</div>"),
        F.lit("</div></ytd-rich-item-renderer>\n"),
    )
    # pages compress well, so that their bytes would ask for a few tasks only; parsing them wants all
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_page = f.select((k / CARDS_PER_PAGE).cast("bigint").alias("page_id"), k, card.alias("card")) \
                .repartition(tasks, "page_id").groupBy("page_id").agg(F.array_join(F.transform(
                    F.array_sort(F.collect_list(F.struct("pos", "card"))), lambda x: x["card"]), "").alias("body"))
    return per_page.select(
        "page_id",
        F.concat(F.lit(MEDIA_BASE + "/feed/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit("<html><body><div id=\"contents\">"), F.col("body"), F.lit("</div></body></html>")).alias("html"))
