"""Physical-plan checks: the plans we want at scale, not just right answers."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from reelhouse.functions import text as TX
from reelhouse.operators import categorize as C
from reelhouse.operators import ingest as I
from reelhouse.operators import library as L
from reelhouse.operators import updates as U
from reelhouse.schema import conform
from reelhouse.sources import fixtures as X
from reelhouse.sources.tables import read_library
from tests.conftest import SF_CHECK


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_links_read_only_the_link_column(spark, tmp_path):
    path = str(tmp_path / "lib")
    conform(X.library(spark, SF_CHECK)).write.parquet(path)
    lib = read_library(spark, path)
    items = I.first_per_link(I.clean_cards(X.feed(spark, SF_CHECK), X.AS_OF, X.MEDIA_BASE))
    p = plan(I.skip_known(items, lib))
    assert "LeftAnti" in p and "ReadSchema: struct<link:string>" in p


def test_winners_are_found_by_hash_aggregates(spark):
    items = I.clean_cards(X.feed(spark, SF_CHECK), X.AS_OF, X.MEDIA_BASE)
    lib = X.library(spark, SF_CHECK)
    flags = lib.select("id", "hidden", F.col("id").alias("ord"))
    p = plan(I.first_per_link(items).select("link", "title")) + plan(U.set_hidden(lib.select("id", "hidden"), flags, "ord").select("id"))
    assert "partial_min" in p and "partial_max" in p
    assert "rangepartitioning" not in plan(L.queue_summaries(lib))


def test_first_per_link_is_partial_aggregate_not_window(spark):
    items = I.clean_cards(X.feed(spark, SF_CHECK), X.AS_OF, X.MEDIA_BASE)
    p = plan(I.first_per_link(items))
    assert "Window" not in p
    assert "partial_min" in p


def test_top_n_is_take_ordered(spark, tmp_path):
    path = str(tmp_path / "lib")
    conform(X.library(spark, SF_CHECK)).write.parquet(path)
    df = L.library_top(read_library(spark, path), "cat_en")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(hidden), Not(EqualTo(hidden,true)), IsNotNull(category), " \
           "EqualTo(category,cat_en)]" in scan or "EqualTo(category,cat_en)" in scan


def test_category_counts_prunes_text(spark, tmp_path):
    path = str(tmp_path / "lib")
    conform(X.library(spark, SF_CHECK)).write.parquet(path)
    p = plan(L.category_counts(read_library(spark, path)))
    assert "subtitles" not in p and "partial_count" in p


def test_keyword_scores_broadcast_vocab_and_combine_map_side(spark):
    vocab = spark.createDataFrame([("News",), ("Music",)], "category string")
    items = X.library(spark, SF_CHECK).select("id", "title")
    p = plan(C.scores(items, "id", TX.category_text(F.col("title")), vocab))
    assert "partial_count" in p and "partial_sum" in p and "CartesianProduct" not in p


def test_import_sql_parses_pages_once(spark):
    p = plan(queries()["import_sql"](spark, SF_CHECK))
    assert p.count("Generate inline") == 1 and p.count("events.parquet") == 1


def test_only_keywords_are_counted(spark):
    vocab = spark.createDataFrame([("News",), ("Music",)], "category string")
    items = spark.createDataFrame([(1, "news of many other words news"), (1, "news"), (2, "nothing")], "id bigint, title string")
    scores = C.scores(items, "id", F.col("title"), vocab)
    p = plan(scores)
    assert "LeftSemi" in p and p.rindex("LeftSemi") > p.rindex("partial_count")  # below the first count
    assert [tuple(r) for r in scores.collect()] == [(1, "News", 3)]


def test_finding_first_cards_is_compiled_by_the_jvm(spark, capsys):
    """The JVM interprets methods over 8000 bytes for good; a rule repeated by filters makes them."""
    import re
    feed = X.feed(spark, SF_CHECK)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan is whole
    try:
        for df in (I.kept_cards(feed, X.MEDIA_BASE), I.first_cards(feed, X.MEDIA_BASE)):
            df.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_items_without_a_link_have_no_first_one(spark):
    items = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), ("a", 1, 1), ("b", None, 7), ("b", 9, None), (None, 1, 1)],
                                  "link string, page_id bigint, pos bigint")
    assert sorted(tuple(r) for r in I.first_per_link(items).collect()) == [("a", 1, 1), ("b", 9, None)]
