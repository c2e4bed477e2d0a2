"""The application's actions as Spark jobs over DataFrames.

Each function takes the library and its inputs as DataFrames and returns new
DataFrames; :func:`reelhouse.operators.snapshots.publish` writes the result
as the next library version.  Nothing is looped over on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions import text as TX
from reelhouse.operators import categorize as C
from reelhouse.operators import categorize_model as CM
from reelhouse.operators import ingest as I
from reelhouse.operators import library as L
from reelhouse.operators import models as M
from reelhouse.operators import snapshots as S
from reelhouse.operators import store as ST
from reelhouse.operators import updates as U
from reelhouse.operators import vocabulary as V
from reelhouse.operators.joins import stable
from reelhouse.schema import LIBRARY_SCHEMA
from reelhouse.sources import captions as CP
from reelhouse.sources import html_cards as H


@dataclass(frozen=True)
class ImportConfig:
    """Job parameters (what the original read from its environment)."""
    categories: str = ""                 # comma-separated configured categories
    allow_any_category: bool = False     # free categories (validated, retried)
    site_base: str = K.SITE_BASE
    two_field: str = "ms"                # "5:30" as M:SS ("hm" = stored H:MM reading)
    summary_size: int = K.SUMMARY_SIZE
    chunk_size: int = K.MAX_TOKENS // 2


def _model_kw(cfg: ImportConfig) -> dict:
    return {"chunk_size": cfg.chunk_size}


def vocabulary(library: DataFrame, cfg: ImportConfig) -> DataFrame:
    """Configured categories plus the stored ones."""
    return V.candidate_vocabulary(V.configured_categories(library.sparkSession, cfg.categories), library)


def ingest(cards: DataFrame, library: DataFrame, captions: DataFrame, as_of: str,
           cfg: ImportConfig = ImportConfig(), model=None, category_model=None) -> tuple[DataFrame, DataFrame]:
    """L1: raw cards -> (new library rows, rejects).

    Cards are cleaned, the first card of each link kept, known links
    skipped; transcripts are attached by link, summarised with the title,
    categorised, and the storable rows numbered after the current max id.  An
    item whose length cannot be stored or whose model call failed is a reject
    with its problem; the others are not held up by it.
    """
    items = stable(I.new_items(cards, library, as_of, cfg.site_base, cfg.two_field))
    done, rejects = enrich(items, library, captions, cfg, model, category_model)
    return I.append_items(library, done, as_of), rejects


def enrich(items: DataFrame, stored: DataFrame, captions: DataFrame, cfg: ImportConfig = ImportConfig(),
           model=None, category_model=None) -> tuple[DataFrame, DataFrame]:
    """New items with transcript, summary and category, and those that cannot be stored with their problem.

    ``items`` should be a table, as it is read more than once; of ``stored``
    only the ``category`` is read.
    """
    ok, rejects = I.split_rejects(items)
    with_subs = CP.attach(ok, captions)
    summed = M.summarize(with_subs, "subtitles", "summary", model=model, size=cfg.summary_size,
                         title_col="title", key="link", **_model_kw(cfg))
    summed, failed = M.split_failures(summed, "summary")
    rejects = rejects.unionByName(failed.select(*[c for c in rejects.columns]))
    vocab = vocabulary(stored, cfg)
    if category_model is not None:
        item = CM.item_text(F.col("title"), F.col("summary"))
        if cfg.allow_any_category:
            cat = CM.categorize_free_by_model(summed, "link", item, vocab, stored, category_model)
        else:
            cat = CM.categorize_by_model(summed, "link", item, vocab, category_model)
        cat, failed = M.split_failures(cat, "category")
        rejects = rejects.unionByName(failed.select(*[c for c in rejects.columns]))
    elif cfg.allow_any_category:
        cat = C.categorize_free(summed, "link", TX.category_text(F.col("title"), F.col("summary")), vocab, stored)
    else:
        cat = C.categorize(summed, "link", TX.category_text(F.col("title"), F.col("summary")), vocab)
    return cat, rejects


def import_pages(pages: DataFrame, root: str, captions: DataFrame, as_of: str,
                 cfg: ImportConfig = ImportConfig(), model=None, category_model=None) -> DataFrame:
    """L1 from stored pages to the stored library under ``root``: extract, ingest, publish.

    The new rows are published with the library's as its next version (which
    checks the library's rules); returns the rejects.  A second run over the
    same pages adds nothing.
    """
    library = S.read_latest(pages.sparkSession, root, LIBRARY_SCHEMA)
    # pages are parsed once: what follows reads the first card of each link
    cards = stable(I.first_cards(stable(H.extract_cards(pages)), cfg.site_base)).drop("link")
    rows, rejects = ingest(cards, library, captions, as_of, cfg, model, category_model)
    S.publish(library.unionByName(stable(rows)), root)
    return rejects


def import_stored(pages: DataFrame, root: str, captions: DataFrame, as_of: str, run: str,
                  cfg: ImportConfig = ImportConfig(), model=None, category_model=None) -> ST.Manifest:
    """L1 from stored pages to the bucketed library under ``root`` (:mod:`reelhouse.operators.store`).

    Every stage is written once under ``root/staging/<run>`` and read by what
    follows: the pages are parsed once, a model is asked once.  The same
    ``run`` started again goes on after the last stage that was finished; a
    run that is committed changes nothing any more.  Rejects are stored with
    the version, so items + rejects are the new links.
    """
    spark, stages = pages.sparkSession, f"{root}/staging/{run}"
    m = ST.open_version(spark, root)
    if run in m.runs:
        return m
    cards = staged(spark, f"{stages}/cards", lambda: I.first_cards(stable(H.extract_cards(pages)), cfg.site_base))
    fresh = staged(spark, f"{stages}/fresh", lambda: I.with_length(I.clean_cards(
        ST.unknown(spark, root, m, cards).drop("link"), as_of, cfg.site_base), cfg.two_field))
    parts = {}

    def enriched(name: str) -> DataFrame:
        if not parts:
            parts["items"], parts["rejects"] = enrich(fresh, ST.stored_categories(spark, root, m), captions, cfg, model, category_model)
        return parts[name]

    items = staged(spark, f"{stages}/items", lambda: enriched("items"))
    rejects = staged(spark, f"{stages}/rejects", lambda: enriched("rejects"))
    done = ST.append(items, root, as_of, failed=rejects.select("link", "problem"), run=run)
    ST.drop_folder(spark, stages)
    return done


def staged(spark, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first unless an earlier attempt finished it."""
    if not S._complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def backfill_subtitles(library: DataFrame, captions: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """L2: attach transcripts to visible items that have none; returns the new library.

    Only the captions of links in the queue are parsed.
    """
    todo = L.queue_subtitles(library, attempts).select("id", "link")
    wanted = captions.join(todo.select("link"), "link", "left_semi")
    found = CP.attach(todo, wanted).where(F.col("subtitles").isNotNull())
    return U.apply_updates(library, found.select("id", "subtitles"), ["subtitles"])


def backfill_themes(library: DataFrame, cfg: ImportConfig = ImportConfig(), model=None) -> DataFrame:
    """L3: themes (and a category from the title) for items with a transcript
    and no themes; the blurb is written empty as the original does."""
    q = L.queue_themes(library).select("id", "title", "subtitles")
    t, _ = M.split_failures(M.themes(q, "subtitles", "themes", model=model, title_col="title", **_model_kw(cfg)), "themes")
    cat = C.categorize(t, "id", TX.category_text(F.col("title")), vocabulary(library, cfg))
    changes = cat.select("id", "themes", F.lit(None).cast("string").alias("blurb"), "category")
    return U.apply_updates(library, changes, ["themes", "blurb", "category"])


def summaries(items: DataFrame, cfg: ImportConfig = ImportConfig(), model=None) -> DataFrame:
    """``(id, summary)`` of the transcripts of ``items``; a failed call changes nothing."""
    out = M.summarize(items.select("id", "subtitles"), "subtitles", "summary", model=model,
                      size=cfg.summary_size, **_model_kw(cfg))
    return M.split_failures(out, "summary")[0].select("id", "summary")


def backfill_summaries(library: DataFrame, cfg: ImportConfig = ImportConfig(), model=None,
                       reset_unused: bool = False) -> DataFrame:
    """L4: summaries for visible items with a transcript and none yet.

    ``reset_unused=True`` also writes NULL over ``themes`` and ``blurb``, as
    the original backfill does.
    """
    changes = summaries(L.queue_summaries(library), cfg, model)
    cols = ["summary"]
    if reset_unused:
        changes = changes.withColumn("themes", F.lit(None).cast("string")) \
                         .withColumn("blurb", F.lit(None).cast("string"))
        cols += ["themes", "blurb"]
    return U.apply_updates(library, changes, cols)


def retry_summaries(library: DataFrame, ids: DataFrame, cfg: ImportConfig = ImportConfig(),
                    model=None) -> DataFrame:
    """M7: regenerate the summaries of the given ids (any number of them)."""
    rows = library.join(ids.select("id"), "id", "left_semi").where(F.col("subtitles").isNotNull())
    return U.apply_updates(library, summaries(rows, cfg, model), ["summary"])


def manage_categories(library: DataFrame, renames: list[tuple[str, str]]) -> DataFrame:
    """Ordered bulk renames / merges of categories."""
    return V.rename_categories(library, renames)


def home(library: DataFrame, category: str | None, as_of: str,
         n: int = K.PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(category picker with counts, newest ``n`` visible items)."""
    return L.category_counts(library), L.library_view(library, category, as_of, n)
