"""Library views, work queues and category aggregates (P*, A1, A2, T1, T2, T4).

All of these are filters, projections, grouped counts and top-k sorts; the
optimizer pushes the predicates into the Parquet scan, prunes the long text
columns when a view does not show them, and turns ``orderBy().limit(n)`` into
a per-task top-n (TakeOrderedAndProject) so no task ever sorts the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelhouse import constants as K
from reelhouse.functions import fields as FF
from reelhouse.functions.dates import age_text, as_of_literal


def visible(lib: DataFrame) -> DataFrame:
    """Rows not hidden."""
    return lib.where(~F.col("hidden"))


def in_category(lib: DataFrame, category: str | None) -> DataFrame:
    """Category equality; ``None`` means every category."""
    return lib if category is None else lib.where(F.col("category") == F.lit(category))


def category_counts(lib: DataFrame) -> DataFrame:
    """A1: visible items per non-null category with its ``"cat (n)"`` label.

    Partial aggregation before the shuffle: a category holding a third of the
    library costs one row per task on the wire.
    """
    counts = (visible(lib).where(F.col("category").isNotNull())
              .groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    return counts.select("category", "n", FF.count_label("category", "n").alias("label")) \
                 .orderBy("category")


def distinct_categories(lib: DataFrame, include_hidden: bool = True) -> DataFrame:
    """A2/T4: every stored category (hidden rows included by default), sorted."""
    src = lib if include_hidden else visible(lib)
    return src.where(F.col("category").isNotNull()).select("category").distinct().orderBy("category")


def newest(lib: DataFrame, n: int | None = K.PAGE_SIZE) -> DataFrame:
    """Newest first; ``n`` rows when given (a top-n, not a full sort)."""
    ordered = lib.orderBy(F.col("id").desc())
    return ordered if n is None else ordered.limit(n)


def library_top(lib: DataFrame, category: str | None = None, n: int = K.PAGE_SIZE) -> DataFrame:
    """Home page rows: visible, optional category, newest ``n``."""
    return newest(in_category(visible(lib), category), n)


def has_subtitles(c: Column | str = "subtitles") -> Column:
    """P10: non-empty transcript."""
    col = F.col(c) if isinstance(c, str) else c
    return F.length(F.coalesce(col, F.lit(""))) > 0


def library_view(lib: DataFrame, category: str | None = None, as_of: str = "",
                 n: int = K.PAGE_SIZE) -> DataFrame:
    """The home page projection.

    The newest row is ``expanded`` (its summary is shown); the others show
    their summary on demand.  Only the page's ``n`` rows are numbered, so the
    rank runs over a bounded set after the top-n.
    """
    top = library_top(lib, category, n)
    ts = as_of_literal(as_of)
    rank = F.row_number().over(Window.orderBy(F.col("id").desc()))
    return top.select(
        "id", "thumbnail", "channel", "category",
        FF.bold("title").alias("title_md"),
        "length_seconds",
        age_text("video_created", ts).alias("age"),
        F.col("progress").cast("string").alias("progress_text"),
        "hidden",
        FF.link_markdown("link").alias("link_md"),
        has_subtitles().alias("has_subtitles"),
        F.when(rank == 1, F.col("summary")).alias("summary_shown"),
        (rank == 1).alias("expanded"),
    )


def queue_subtitles(lib: DataFrame, attempts: DataFrame | None = None, most: int = 1) -> DataFrame:
    """P5: visible items without a transcript.

    ``attempts (id)``, one row for each try that found no captions, takes out
    the items tried ``most`` times, so a run does not pick them again.  The
    queue is a set; a view orders it by ``newest``.
    """
    todo = visible(lib).where(F.col("subtitles").isNull())
    if attempts is None:
        return todo
    tried = attempts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
    return todo.join(tried.select("id"), "id", "left_anti")


def queue_themes(lib: DataFrame) -> DataFrame:
    """Visible items with a transcript and no themes yet."""
    return visible(lib).where(F.col("themes").isNull() & F.col("subtitles").isNotNull())


def queue_summaries(lib: DataFrame) -> DataFrame:
    """Visible items with a transcript and no summary."""
    return visible(lib).where(F.col("subtitles").isNotNull() & F.col("summary").isNull())


def lookup(lib: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of the given ids (a semi join, works for one id or millions)."""
    return lib.select("id", "link").join(ids.select("id"), "id", "left_semi")
