"""The application's actions as jobs."""

from pyspark.sql import functions as F

from reelhouse.operators import models as M
from reelhouse.plans import jobs as J
from reelhouse.schema import LIBRARY_COLUMNS, validate_library
from reelhouse.sources import fixtures as X
from tests.conftest import SF_CHECK

CFG = J.ImportConfig(categories="News, cat_en", site_base=X.MEDIA_BASE)


def test_ingest_free_categories(spark):
    lib = X.library(spark, SF_CHECK)
    cfg = J.ImportConfig(categories="News, cat_en", site_base=X.MEDIA_BASE, allow_any_category=True)
    rows, rejects = J.ingest(X.feed(spark, SF_CHECK), lib, X.captions(spark, SF_CHECK), X.AS_OF, cfg)
    assert rows.columns == LIBRARY_COLUMNS
    got = rows.collect()
    assert got and all(r.category is not None for r in got)
    assert rejects.count() > 0
    assert validate_library(lib.unionByName(rows)).count() == 0


def test_ingest_with_python_model_matches_expression_model(spark):
    lib = X.library(spark, SF_CHECK)
    args = (X.feed(spark, SF_CHECK), lib, X.captions(spark, SF_CHECK), X.AS_OF, CFG)
    a = {r.link: r.summary for r in J.ingest(*args)[0].collect()}
    b = {r.link: r.summary for r in J.ingest(*args, model=M.extract_batch_model(4))[0].collect()}
    assert a == b and any(v for v in a.values())


def test_backfill_summaries_reset_unused(spark):
    lib = X.library(spark, SF_CHECK)
    todo = {r.id for r in lib.where("NOT hidden AND subtitles IS NOT NULL AND summary IS NULL").collect()}
    out = {r.id: r for r in J.backfill_summaries(lib, CFG, reset_unused=True).collect()}
    assert all(out[i].summary and out[i].themes is None for i in todo)
    before = {r.id: r.themes for r in lib.collect()}
    assert all(out[i].themes == before[i] for i in out if i not in todo)


def test_retry_and_home(spark):
    lib = X.library(spark, SF_CHECK)
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    out = {r.id: r.summary for r in J.retry_summaries(lib, ids, CFG).collect()}
    assert out[1] and out[2]
    counts, view = J.home(lib, "cat_en", X.AS_OF)
    assert view.count() == 50 and view.where(F.col("category") != "cat_en").count() == 0
    assert counts.count() == 4


def test_backfill_themes_writes_blurb_and_category(spark):
    lib = X.library(spark, SF_CHECK)
    out = J.backfill_themes(lib, CFG)
    q = lib.where("NOT hidden AND themes IS NULL AND subtitles IS NOT NULL").select("id")
    done = out.join(q, "id").collect()
    assert done and all(r.themes.startswith("- ") and r.blurb is None for r in done)


def test_a_word_at_the_end_of_a_text_decides_its_category(spark):
    from reelhouse.functions import text as TX
    from reelhouse.operators import categorize as C
    items = spark.createDataFrame([(1, "T", "filler. " * 5000 + "music"), (2, "T", "filler. " * 5000)], "id int, title string, text string")
    vocab = spark.createDataFrame([("Music",), ("News",)], "category string")
    got = C.categorize(items, "id", TX.category_text(F.col("title"), F.col("text")), vocab)
    assert {r.id: r.category for r in got.collect()} == {1: "Music", 2: None}


def test_staged_import_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from reelhouse.operators import store as ST
    from reelhouse.sources import html_cards as H
    root, lib = str(tmp_path / "store"), X.library(spark, SF_CHECK)
    ST.create(lib, root, bucket_rows=200, link_buckets=8)
    parses, real = [], H.extract_cards
    monkeypatch.setattr(H, "extract_cards", lambda pages, *a: parses.append(1) or real(pages, *a))
    args = (X.feed_pages(spark, SF_CHECK), root, X.captions(spark, SF_CHECK), X.AS_OF)
    plans = []

    def broken(items, *a, **k):
        plans.append(items._jdf.queryExecution().executedPlan().toString())
        raise RuntimeError("the job was lost")

    with monkeypatch.context() as m:
        m.setattr(ST, "append", broken)
        try:
            J.import_stored(*args, "run", CFG)
        except RuntimeError:
            pass
    assert len(parses) == 1 and "MapIn" not in plans[0]  # what is committed is read from its stage
    done = J.import_stored(*args, "run", CFG)
    assert len(parses) == 1 and done.version == 1
    want, rejects = J.ingest(real(args[0]), lib, *args[2:], CFG)
    got = ST.read(spark, root).where(F.col("id") > lib.agg(F.max("id")).first()[0])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10
    assert {r.link for r in ST.rejects(spark, root).collect()} == {r.link for r in rejects.collect()}
    assert J.import_stored(*args, "run", CFG) == done and len(parses) == 1  # committed: nothing is done
    assert ST._names(spark, f"{root}/staging") == []
    again = J.import_stored(*args, "next", CFG)
    assert {r.attempts for r in ST.rejects(spark, root).collect()} == {2} and again.data == done.data


def test_a_replayed_micro_batch_commits_nothing_more(spark, tmp_path):
    from reelhouse.operators import ingest as I
    from reelhouse.operators import store as ST
    from reelhouse.streaming import incremental as INC
    root, feed = str(tmp_path / "store"), X.feed(spark, SF_CHECK)
    ST.create(X.library(spark, SF_CHECK), root, bucket_rows=200, link_buckets=8)
    for drop in (feed.where("page_id <= 15"), feed.where("page_id > 15")):
        INC.stage_cards(drop, f"{root}/cards")
    INC.run_stored_import(spark, f"{root}/cards", root, f"{root}/checkpoint", X.AS_OF, X.MEDIA_BASE, files_per_batch=1)
    m = ST.open_version(spark, root)
    links = [r.link for r in ST.read(spark, root).select("link").collect()]
    assert len(links) == len(set(links)) and len(m.runs) > 1
    items = I.with_length(I.clean_cards(I.first_cards(feed, X.MEDIA_BASE).drop("link"), X.AS_OF, X.MEDIA_BASE)).limit(3)
    assert ST.append(items, root, X.AS_OF, run=m.runs[0]) == m
    INC.run_stored_import(spark, f"{root}/cards", root, f"{root}/checkpoint", X.AS_OF, X.MEDIA_BASE)
    assert ST.open_version(spark, root) == m
