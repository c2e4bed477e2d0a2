"""Transcript, text, vocabulary, update and model queries (F10-F17, J2-J5,
K2-K4, M1-M6, L2-L4, U1, S4, S5, A3-A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions import text as TX
from reelhouse.operators import categorize as C
from reelhouse.operators import categorize_model as CM
from reelhouse.operators import library as L
from reelhouse.operators import models as M
from reelhouse.operators import updates as U
from reelhouse.operators import vocabulary as V
from reelhouse.plans import jobs as J
from reelhouse.plans.registry import query
from reelhouse.sources import captions as CP
from reelhouse.sources import fixtures as X
from reelhouse.sources.tables import read_table

CONFIGURED = "News, Music ,,Science & Tech, cat_en, uncategorized"
RENAMES = [("cat_de", "German"), ("German", "Deutsch"), ("cat_es", ""), ("cat_fr", "cat_en")]
CHUNK = K.MAX_TOKENS // 2


def _vocab(spark, lib):
    return V.candidate_vocabulary(V.configured_categories(spark, CONFIGURED), lib)


# ---- transcripts -------------------------------------------------------------

@query("captions_to_text")
def captions_to_text(spark, sf_dir):
    return CP.transcripts(X.captions(spark, sf_dir))


@query("backfill_subtitles")
def backfill_subtitles(spark, sf_dir):
    return J.backfill_subtitles(X.library(spark, sf_dir), X.captions(spark, sf_dir)) \
            .select("id", F.length("subtitles").cast("bigint").alias("subtitle_chars"),
                    F.sha2(F.coalesce("subtitles", F.lit("")), 256).alias("subtitle_hash"))


# ---- chunks and answers ------------------------------------------------------

@query("text_chunks")
def text_chunks(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(TX.chunks("text", CHUNK)).alias("chunk_no", "chunk")) \
            .select("doc_id", F.col("chunk_no").cast("bigint"), "chunk")


@query("chunks_rejoined")
def chunks_rejoined(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    parts = d.select("doc_id", F.posexplode(TX.chunks("text", CHUNK)).alias("i", "c"))
    back = parts.groupBy("doc_id").agg(F.array_join(TX.ordered_join("i", "c"), "").alias("joined"),
                                       F.count(F.lit(1)).alias("n_chunks"))
    return back.join(d.select("doc_id", "text"), "doc_id") \
               .select("doc_id", "n_chunks", (F.col("joined") == F.col("text")).alias("same"))


@query("clean_response")
def clean_response(spark, sf_dir):
    a = X.model_answers(spark, sf_dir)
    return a.select("id", F.col("chunk").cast("bigint").alias("chunk"),
                    TX.join_responses(F.array("response")).alias("answer"))


@query("reassemble_answers")
def reassemble_answers(spark, sf_dir):
    a = X.model_answers(spark, sf_dir)
    return a.groupBy("id").agg(TX.join_responses(TX.ordered_join("chunk", "response")).alias("answer"))


# ---- category answers and vocabulary -----------------------------------------

@query("clean_category")
def clean_category(spark, sf_dir):
    a = X.category_answers(spark, sf_dir)
    c = TX.clean_category("answer")
    return a.select("id", c.alias("category"), TX.word_count(c).alias("words"),
                    c.contains('"').alias("has_quote"))


@query("category_membership")
def category_membership(spark, sf_dir):
    lib = X.library(spark, sf_dir)
    a = X.category_answers(spark, sf_dir).select("id", TX.clean_category("answer").alias("category"))
    a = a.union(X.pattern_answers(spark, sf_dir))
    m = V.membership(a, "category", lib)
    return m.select("id", "category", "known",
                    V.is_valid_answer(F.col("known"), F.col("category")).alias("valid"))


@query("candidate_vocabulary")
def candidate_vocabulary(spark, sf_dir):
    return _vocab(spark, X.library(spark, sf_dir))


@query("vocabulary_text")
def vocabulary_text(spark, sf_dir):
    return V.vocabulary_text(_vocab(spark, X.library(spark, sf_dir)))


@query("tool_call_category")
def tool_call_category(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    calls = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("call"),
                     F.to_json(F.struct(F.concat(F.lit("cat_"), F.col("role")).alias("category"),
                                        F.length("text").alias("chars"))).alias("arguments"))
    return calls.groupBy("id").agg(F.max_by(TX.tool_call_category("arguments"), "call").alias("category"))


# ---- updates -------------------------------------------------------------------

@query("rename_categories")
def rename_categories(spark, sf_dir):
    return V.rename_categories(X.library(spark, sf_dir), RENAMES).select("id", "category")


@query("set_hidden")
def set_hidden(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    hide = lab.select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("hidden"), F.lit(1).alias("ord"))
    back = lab.where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("hidden"), F.lit(2).alias("ord"))
    return U.set_hidden(X.library(spark, sf_dir), back.union(hide), "ord").select("id", "hidden")


@query("apply_updates")
def apply_updates(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    changes = lab.select(F.col("doc_id").alias("id"),
                         F.when(F.col("quality") == 1, F.lit("reviewed")).alias("summary"),
                         F.concat(F.lit("- toxic "), F.col("toxic").cast("string")).alias("themes"),
                         F.lit(5).alias("ord"))
    # a later change of every third id empties both columns again
    later = changes.where(F.col("id") % 3 == 0).select(
        "id", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("themes"), F.lit(9).alias("ord"))
    return U.apply_updates(X.library(spark, sf_dir), later.union(changes), ["summary", "themes"], "ord") \
            .select("id", "summary", "themes", "category")


# ---- model operators -----------------------------------------------------------

@query("summarize_lead")
def summarize_lead(spark, sf_dir):
    q = L.queue_summaries(X.library(spark, sf_dir)).select("id", "subtitles")
    return M.summarize(q, "subtitles", "summary").select("id", "summary")


@query("summarize_batch")
def summarize_batch(spark, sf_dir):
    q = L.queue_summaries(X.library(spark, sf_dir)).select("id", "subtitles")
    return M.summarize(q, "subtitles", "summary", model=M.extract_batch_model()).select("id", "summary")


@query("summarize_import")
def summarize_import(spark, sf_dir):
    lib = X.library(spark, sf_dir).where(F.col("subtitles").isNotNull()).select("id", "title", "subtitles")
    return M.summarize(lib, "subtitles", "summary", title_col="title").select("id", "summary")


@query("enrich_rejects")
def enrich_rejects(spark, sf_dir):
    """A model that fails on some chunks: every row comes back, answered or with its error."""
    def fails(_instructions, texts):
        if any(len(t) % 5 == 0 for t in texts):
            raise ValueError("refused")
        return [t[-20:] for t in texts]

    q = L.queue_summaries(X.library(spark, sf_dir)).select("id", "subtitles")
    ok, bad = M.split_failures(M.summarize(q, "subtitles", "summary", model=M.BatchModel(fails, 7)), "summary")
    return ok.select("id", "summary", F.lit(None).cast("string").alias("problem")).unionByName(
        bad.select("id", "summary", "problem"))


@query("blurb_lead")
def blurb_lead(spark, sf_dir):
    lib = X.library(spark, sf_dir).where(F.col("subtitles").isNotNull()).select("id", "subtitles")
    return M.blurb(lib, "subtitles").select("id", "blurb")


@query("backfill_themes")
def backfill_themes(spark, sf_dir):
    lib = X.library(spark, sf_dir)
    q = L.queue_themes(lib).select("id", "title", "subtitles")
    t = M.themes(q, "subtitles", "themes", title_col="title")
    cat = C.categorize(t, "id", TX.category_text(F.col("title")), _vocab(spark, lib))
    return cat.select("id", "themes", "category")


@query("categorize_keyword")
def categorize_keyword(spark, sf_dir):
    lib = X.library(spark, sf_dir)
    items = L.visible(lib).select("id", "title").join(X.texts(spark, sf_dir), "id")
    out = C.categorize(items, "id", TX.category_text(F.col("title"), F.col("text")), _vocab(spark, lib))
    return out.select("id", "category")


@query("categorize_free")
def categorize_free(spark, sf_dir):
    lib = X.library(spark, sf_dir)
    items = L.visible(lib).select("id", "title", "themes").join(X.texts(spark, sf_dir), "id")
    text = TX.category_text(F.col("title"), F.col("text"), F.col("themes"))
    out = C.categorize_free(items, "id", text, _vocab(spark, lib), lib)
    return out.select("id", "category")


# ---- categories by a model --------------------------------------------------------

def _naming_model() -> M.BatchModel:
    """Deterministic: reads the mark in an item and what was turned down before."""
    import re

    def fn(_instructions, prompts):
        out = []
        for p in prompts:
            kind, retried = re.search(r"#([0-9])", p)[1], "PREVIOUS" in p
            if kind == "4" and not retried:
                raise ValueError("no answer")
            out.append({"0": "Category: **cat_EN** fits", "1": "an answer of five words", "2": "cat_fr" if retried else '"cat_fr"',
                        "3": "nothing known", "4": "x"}[kind])
        return out
    return M.BatchModel(fn, 16)


def _marked_items(spark, sf_dir):
    lib = X.library(spark, sf_dir)
    whole = L.visible(lib).select("id", "title", "themes").join(X.texts(spark, sf_dir), "id")
    items = M.summarize(whole, "text", "summary").drop("text")
    mark = F.concat(F.col("title"), F.lit(" #"), (F.col("id") % 5).cast("string"))
    return lib, items, CM.item_text(mark, F.col("summary"), F.col("themes"))


@query("categorize_model")
def categorize_model(spark, sf_dir):
    lib, items, item = _marked_items(spark, sf_dir)
    out = CM.categorize_by_model(items, "id", item, _vocab(spark, lib), _naming_model())
    return out.select("id", "category", F.col("category_error").alias("problem"))


@query("categorize_free_model")
def categorize_free_model(spark, sf_dir):
    lib, items, item = _marked_items(spark, sf_dir)
    out = CM.categorize_free_by_model(items, "id", item, _vocab(spark, lib), lib, _naming_model())
    return out.select("id", "category", F.col("category_error").alias("problem"))
