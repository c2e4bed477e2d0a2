"""Import: clean cards, keep the first card per link, skip known links,
number the new items, split off rows that cannot be stored (F3-F9, T3, J1,
K1, K6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelhouse import constants as K
from reelhouse.functions import dates as D
from reelhouse.functions import fields as FF
from reelhouse.operators.joins import stable
from reelhouse.schema import LIBRARY_COLUMNS, conform

ITEM_COLUMNS = ["page_id", "pos", "link", "title", "channel", "thumbnail", "progress",
                "length_text", "video_created"]


def first_date_span(spans) -> F.Column:
    """First metadata span that reads like a date, NULL when none does."""
    return F.try_element_at(F.filter(spans, D.is_date_text), F.lit(1))


def _shown(cards: DataFrame) -> DataFrame:
    """Cards that are no ad, sponsored or collection card."""
    return cards.where(~(F.coalesce("is_ad", F.lit(False)) | F.coalesce("is_sponsored", F.lit(False))
                         | F.coalesce("is_collection", F.lit(False))))


def _title() -> F.Column:
    return F.when(F.col("title_text").isNotNull(), FF.title("title_attr", "title_text"))


def _storable(cards: DataFrame) -> DataFrame:
    """Cards that are shown and have a link and a title element.

    Asked of the raw columns: a filter on the link and the title would repeat
    their rules in the generated code, which the JVM then no longer compiles
    (it leaves methods over 8000 bytes to the interpreter).
    """
    return _shown(cards).where((F.col("href") != "") & F.col("title_text").isNotNull())


def kept_cards(cards: DataFrame, site_base: str = K.SITE_BASE) -> DataFrame:
    """Raw cards that cleaning keeps, with their ``link``."""
    return _storable(cards).withColumn("link", FF.canonical_link("href", site_base))


def clean_cards(cards: DataFrame, as_of: str, site_base: str = K.SITE_BASE) -> DataFrame:
    """Raw cards -> items: skip ads, sponsored and collection cards; canonical
    link; title; thumbnail fallback; length badge; progress; created date.

    Cards without a link or without a title element are dropped.  Pure
    projection and filter: no shuffle, runs in one codegen stage.
    """
    ts = D.as_of_literal(as_of)
    kept = _storable(cards)
    # Stage 1 computes the values later rules read more than once; Catalyst
    # keeps the two projections apart (one codegen stage, each value once).
    staged = kept.select(
        "page_id", "pos",
        FF.canonical_link("href", site_base).alias("link"),
        _title().alias("title"),
        "channel", "thumb_src",
        FF.progress_pct("progress_style").alias("progress"),
        FF.badge_length("length_text").alias("_badge"),
        first_date_span(F.col("meta_spans")).alias("_date"),
    )
    return staged.select(
        "page_id", "pos", "link", "title", "channel",
        FF.thumbnail("thumb_src", "link").alias("thumbnail"),
        "progress",
        FF.normalize_length("_badge").alias("length_text"),
        D.relative_created("_date", ts).alias("video_created"),
    )


def first_per_link(items: DataFrame) -> DataFrame:
    """The first card of every link in feed order (page_id, pos).

    The order is packed in one fixed-width decimal, so the grouped minimum is
    a hash aggregate (no sort of wide rows) and a link that fills a third of
    the feed leaves each map task as one row.  The winners are then joined to
    their rows; rows equal in link and order are one card.  The keys are
    compared null-safely, as an equality would add filters that repeat their
    rules for every card (see ``_storable``); items without a link are dropped.
    """
    last = F.lit(2 ** 63 - 1)  # a missing page or position comes last
    part = lambda c: F.coalesce(F.col(c), last).cast("decimal(19,0)")
    order = (part("page_id") * F.lit(str(2 ** 63)).cast("decimal(19,0)") + part("pos")).cast("decimal(38,0)")
    keyed = items.withColumn("_order", order)
    first = keyed.where(F.col("link").isNotNull()).groupBy(F.col("link").alias("_link")).agg(F.min("_order").alias("_first"))
    same = F.col("link").eqNullSafe(F.col("_link")) & F.col("_order").eqNullSafe(F.col("_first"))
    return keyed.join(first, same, "left_semi").dropDuplicates(["link", "_order"]).select(*items.columns)


def first_cards(cards: DataFrame, site_base: str = K.SITE_BASE) -> DataFrame:
    """T3 on raw cards: ``cards`` with ``link``, the first storable card of every link.

    Only what decides is computed (flags, link, title), so the other fields
    are cleaned for the winners alone; ``clean_cards`` of the result is
    ``first_per_link`` of all cleaned cards.
    """
    return first_per_link(kept_cards(cards, site_base))


def skip_known(items: DataFrame, library: DataFrame) -> DataFrame:
    """Drop items whose link is already stored (hidden rows included).

    A plain anti join on the ``link`` column; adaptive execution decides by
    bytes how it runs.
    """
    return items.join(library.select("link"), "link", "left_anti")


def with_length(items: DataFrame, two_field: str = "ms") -> DataFrame:
    """Seconds and, when it cannot be stored, the reason (F2)."""
    return items.withColumn("length_seconds", FF.length_seconds("length_text", two_field)) \
                .withColumn("problem", FF.length_problem("length_text"))


def split_rejects(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6: (rows that can be stored, rows with the reason they cannot)."""
    ok = items.where(F.col("problem").isNull()).drop("problem")
    bad = items.where(F.col("problem").isNotNull())
    return ok, bad


def assign_ids(new: DataFrame, start_after: int, order: list[str], key: str = "link") -> DataFrame:
    """K1: ids ``start_after + 1 ...`` in ``order``, computed without a
    single-partition window.

    Only the unique ``key`` and the order columns are range-sorted across
    tasks; each task numbers its rows (``monotonically_increasing_id`` is dense
    within a partition); the per-partition row counts (one row per partition)
    give each partition its offset, joined back by broadcast.  The numbered
    keys are checkpointed so a retried task sees the same numbers, and joined
    to the rows.
    """
    numbered = stable(new.select(key, *order).orderBy(*order)
                      .withColumn("_p", F.spark_partition_id())
                      .withColumn("_m", F.monotonically_increasing_id()))
    per_part = numbered.groupBy("_p").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    offsets = per_part.select(
        "_p", "_m0",
        (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0))).alias("_off"))
    # one row per partition: a proven small side
    joined = numbered.join(F.broadcast(offsets), "_p")
    ids = joined.select(key, (F.lit(start_after) + F.col("_off") + (F.col("_m") - F.col("_m0")) + 1).alias("id"))
    return new.join(ids, key)


def max_id(library: DataFrame) -> int:
    """Largest stored id (0 for an empty library)."""
    v = library.agg(F.max("id")).first()[0]
    return int(v) if v is not None else 0


def to_library_rows(items: DataFrame, as_of: str) -> DataFrame:
    """New items with library defaults: no enrichment yet, not hidden."""
    defaults = {
        "subtitles": F.lit(None).cast("string"),
        "summary": F.lit(None).cast("string"),
        "blurb": F.lit(None).cast("string"),
        "themes": F.lit(None).cast("string"),
        "category": F.lit(None).cast("string"),
        "record_created": D.as_of_literal(as_of),
        "hidden": F.lit(False),
    }
    cols = [defaults[c].alias(c) if c in defaults and c not in items.columns else F.col(c)
            for c in LIBRARY_COLUMNS]
    return conform(items.select(*cols))


def new_items(cards: DataFrame, library: DataFrame, as_of: str,
              site_base: str = K.SITE_BASE, two_field: str = "ms") -> DataFrame:
    """Cards -> cleaned, first-per-link, unknown items with length and problem; cleaned last."""
    fresh = skip_known(first_cards(cards, site_base), library)
    return with_length(clean_cards(fresh.drop("link"), as_of, site_base), two_field)


def append_items(library: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """K1: storable items numbered after the current max id, as library rows."""
    numbered = assign_ids(items, max_id(library), ["page_id", "pos"])
    return to_library_rows(numbered, as_of)
