"""Import properties: idempotence, unique links, rows in = rows out + rejects."""

from pyspark.sql import functions as F

from reelhouse.operators import ingest as I
from reelhouse.schema import validate_library
from reelhouse.sources import fixtures as X
from reelhouse.streaming import incremental as ST
from tests.conftest import SF_CHECK as SF_SMALL


def test_ingest_twice_is_ingest_once(spark):
    lib = X.library(spark, SF_SMALL)
    feed = X.feed(spark, SF_SMALL)
    items = I.new_items(feed, lib, X.AS_OF, X.MEDIA_BASE)
    ok, bad = I.split_rejects(items)
    n_items, n_ok, n_bad = items.count(), ok.count(), bad.count()
    assert n_items == n_ok + n_bad and n_ok > 0 and n_bad > 0
    new = I.append_items(lib, ok, X.AS_OF)
    lib2 = lib.unionByName(new)
    assert validate_library(lib2).count() == 0
    ids = [r.id for r in new.orderBy("id").collect()]
    top = lib.agg(F.max("id")).first()[0]
    assert ids == list(range(top + 1, top + 1 + n_ok))
    again = I.new_items(feed, lib2, X.AS_OF, X.MEDIA_BASE)
    assert again.where(F.col("problem").isNull()).count() == 0


def test_first_card_wins(spark):
    cards = X.feed(spark, SF_SMALL)
    items = I.clean_cards(cards, X.AS_OF, X.MEDIA_BASE)
    first = {r.link: (r.page_id, r.pos) for r in I.first_per_link(items).collect()}
    brute = {}
    for r in items.orderBy("page_id", "pos").collect():
        brute.setdefault(r.link, (r.page_id, r.pos))
    assert first == brute


def test_hidden_items_are_not_reimported(spark):
    lib = X.library(spark, SF_SMALL).withColumn("hidden", F.lit(True))
    items = I.first_per_link(I.clean_cards(X.feed(spark, SF_SMALL), X.AS_OF, X.MEDIA_BASE))
    fresh = I.skip_known(items, lib)
    known = {r.link for r in lib.select("link").collect()}
    assert not ({r.link for r in fresh.collect()} & known)


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") % 37).alias("page_id"), F.col("id").alias("pos")) \
              .repartition(7)
    out = I.assign_ids(df, 100, ["page_id", "pos"], "pos").orderBy("id").collect()
    assert [r.id for r in out] == list(range(101, 5101))
    assert [(r.page_id, r.pos) for r in out] == sorted((r.page_id, r.pos) for r in out)


def test_stream_equals_batch(spark, tmp_path):
    lib = X.library(spark, SF_SMALL)
    feed = X.feed(spark, SF_SMALL)
    ST.stage_cards(feed, str(tmp_path / "cards"))
    ST.run_import(spark, str(tmp_path / "cards"), lib, str(tmp_path / "out"), str(tmp_path / "ck"),
                  X.AS_OF, X.MEDIA_BASE, files_per_batch=2)
    streamed = {r.link for r in ST.read_output(spark, str(tmp_path / "out")).collect()}
    batch = {r.link for r in I.skip_known(I.first_per_link(I.clean_cards(feed, X.AS_OF, X.MEDIA_BASE)), lib)
             .collect()}
    assert streamed == batch and streamed


def test_stream_one_batch_keeps_feed_order_first(spark, tmp_path):
    """A single micro-batch picks the same first card per link as the batch import."""
    lib = X.library(spark, SF_SMALL)
    feed = X.feed(spark, SF_SMALL)
    ST.stage_cards(feed, str(tmp_path / "cards"))
    ST.run_import(spark, str(tmp_path / "cards"), lib, str(tmp_path / "out"), str(tmp_path / "ck"),
                  X.AS_OF, X.MEDIA_BASE)
    streamed = sorted((r.link, r.page_id, r.pos) for r in ST.read_output(spark, str(tmp_path / "out")).collect())
    batch = sorted((r.link, r.page_id, r.pos) for r in
                   I.skip_known(I.first_per_link(I.clean_cards(feed, X.AS_OF, X.MEDIA_BASE)), lib).collect())
    assert streamed == batch and streamed


def test_attach_one_transcript_per_link(spark):
    from reelhouse.sources import captions as CP
    cap = spark.createDataFrame(
        [("l1", "a.en", '{"events":[{"segs":[{"utf8":"b"}]}]}'),
         ("l1", "a.en", '{"events":[{"segs":[{"utf8":"a"}]}]}'),
         ("l1", "en", '{"events":[{"segs":[{"utf8":"x"}]}]}'),
         ("l2", "a.en", '{"events":[{"segs":[{"utf8":"c"}]}]}')], "link string, track string, json string")
    items = spark.createDataFrame([(1, "l1"), (2, "l2"), (3, "l3")], "id bigint, link string")
    out = sorted((r.id, r.subtitles) for r in CP.attach(items, cap).collect())
    assert out == [(1, "a"), (2, "c"), (3, None)]      # the smaller copy wins
