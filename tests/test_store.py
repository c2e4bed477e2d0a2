"""The stored library: what a change writes, races, snapshots by reference, maintained counts."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from reelhouse.operators import library as L
from reelhouse.operators import store as ST
from reelhouse.operators import updates as U
from reelhouse.operators import vocabulary as V
from reelhouse.schema import LIBRARY_SCHEMA
from reelhouse.sources import fixtures as X
from tests.conftest import SF_SMALL

AS_OF = "2024-02-01 00:00:00"
WHEN = dt.datetime(2024, 1, 1)


def library(spark, n=60, first=1):
    rows = [(i, f"t{i}", f"https://m/{i}", None, None, f"text {i}", None, None, None, i % 100, ("a", "b", None)[i % 3],
             None, 60 * i, WHEN, i % 7 == 0) for i in range(first, first + n)]
    return spark.createDataFrame(rows, LIBRARY_SCHEMA)


def items(spark, links, page=1):
    rows = [(page, p, link, f"title {link}", None, None, 5, None, None) for p, link in enumerate(links)]
    return spark.createDataFrame(rows, "page_id long, pos long, link string, title string, channel string, thumbnail string, "
                                       "progress int, video_created timestamp_ntz, length_seconds long")


def rows(df):
    return sorted(map(str, df.select(*[f.name for f in LIBRARY_SCHEMA]).collect()))


def counts_hold(spark, root):
    """The maintained counts are those of a full recount."""
    assert ST.category_counts(spark, root).collect() == L.category_counts(ST.read(spark, root)).collect()
    assert ST.distinct_categories(spark, root).collect() == L.distinct_categories(ST.read(spark, root)).collect()


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_updates_write_only_touched_buckets(spark, root):
    lib = library(spark)
    one = ST.create(lib, root, bucket_rows=10, link_buckets=4)
    assert rows(ST.read(spark, root)) == rows(lib) and sorted(one.data) == [str(b) for b in range(7)]
    changes = spark.createDataFrame([(12, "x"), (15, None), (999, "nobody")], "id long, category string")
    two = ST.update(changes, ["category"], root)
    assert {b for b in two.data if two.data[b] != one.data[b]} == {"1"} and two.links == one.links
    assert rows(ST.read(spark, root)) == rows(U.apply_updates(lib, changes, ["category"]))
    assert rows(ST.read(spark, root, one)) == rows(lib)  # a reader of the old version sees it whole
    counts_hold(spark, root)
    assert ST.update(changes.where("id = 999"), ["category"], root) == two  # nothing to change, no version
    with pytest.raises(ValueError):
        ST.update(changes.select("id", F.col("category").alias("link")), ["link"], root)


def test_bad_rows_are_not_stored(spark, root):
    one = ST.create(library(spark, 20), root, bucket_rows=10, link_buckets=4)
    for bad in (spark.createDataFrame([(3, None)], "id long, title string"),):
        with pytest.raises(ValueError, match="title is null"):
            ST.update(bad, ["title"], root)
    assert ST.open_version(spark, root) == one
    with pytest.raises(ValueError, match="link is not unique"):
        ST.create(library(spark, 5).withColumn("link", F.lit("same")), root + "2")
    with pytest.raises(FileExistsError):
        ST.create(library(spark, 5), root)


def test_appends_skip_known_links_and_number_on(spark, root):
    ST.create(library(spark, 25), root, bucket_rows=10, link_buckets=4)
    old = ST.open_version(spark, root)
    new = ST.append(items(spark, ["https://m/3", "n1", "n2", "https://m/25", "n3"]), root, AS_OF)
    got = {r.link: r.id for r in ST.read(spark, root).where("id > 25").collect()}
    assert got == {"n1": 26, "n2": 27, "n3": 28}
    assert {b for b in new.data if new.data[b] != old.data.get(b)} == {"2"} and new.data["2"][0] == old.data["2"][0]
    counts_hold(spark, root)
    assert ST.append(items(spark, ["n1", "n3"], 9), root, AS_OF) == new  # all known: nothing changes
    assert {r.id for r in ST.lookup(spark, root, spark.createDataFrame([(26,), (1,), (77,)], "id long")).collect()} == {26, 1}


def test_imports_read_only_the_link_buckets_they_fall_into(spark, root):
    m = ST.create(library(spark, 40), root, bucket_rows=10, link_buckets=64)
    few = items(spark, ["https://m/3", "zz"])
    left = ST.unknown(spark, root, m, few)
    assert [r.link for r in left.collect()] == ["zz"]
    folders = {f.split("/")[-2] for f in left.inputFiles()}
    assert 1 <= len(folders) <= 2 < len(m.links)


def test_two_writers_lose_nothing(spark, root, monkeypatch):
    ST.create(library(spark, 20), root, bucket_rows=10, link_buckets=4)
    real, raced = ST._claim, []

    def slow(session, path, text):
        if not raced:  # between building and claiming, another writer commits the same number
            raced.append(path)
            ST.append(items(spark, ["first", "both"]), root, AS_OF)
        return real(session, path, text)

    monkeypatch.setattr(ST, "_claim", slow)
    ST.append(items(spark, ["both", "second"]), root, AS_OF)
    assert ST.versions(spark, root) == [0, 1, 2]
    got = {r.link: r.id for r in ST.read(spark, root).where("id > 20").collect()}
    assert got == {"first": 21, "both": 22, "second": 23}
    counts_hold(spark, root)


def test_writers_in_threads(spark, root):
    ST.create(library(spark, 20), root, bucket_rows=10, link_buckets=4)
    work = [lambda: ST.append(items(spark, ["a1", "s"]), root, AS_OF), lambda: ST.append(items(spark, ["s", "b1"]), root, AS_OF),
            lambda: ST.set_hidden(spark.createDataFrame([(2, True)], "id long, hidden boolean"), root)]
    threads = [threading.Thread(target=w) for w in work]
    [t.start() for t in threads]
    [t.join() for t in threads]
    lib = ST.read(spark, root)
    assert ST.versions(spark, root) == [0, 1, 2, 3]
    assert sorted(r.id for r in lib.where("id > 20").collect()) == [21, 22, 23]
    assert lib.where("id = 2").first().hidden and lib.count() == 23
    counts_hold(spark, root)


def test_a_taken_number_is_not_overwritten(spark, root):
    assert ST._claim(spark, f"{root}/versions/1.json", "one") and not ST._claim(spark, f"{root}/versions/1.json", "two")
    assert ST._read_text(spark, f"{root}/versions/1.json") == "one"
    assert ST._names(spark, f"{root}/versions") == ["1.json"]


def test_snapshots_copy_nothing_and_keep_what_they_name(spark, root):
    lib = library(spark)
    ST.create(lib, root, bucket_rows=10, link_buckets=4)
    before = ST._names(spark, f"{root}/data")
    assert ST.snapshot(spark, root, "2024-02-01 10:00:00") == "20240201"
    assert ST.snapshot(spark, root, "2024-02-01 11:00:00") is None
    assert ST._names(spark, f"{root}/data") == before
    ST.set_hidden(spark.createDataFrame([(5, True)], "id long, hidden boolean"), root)
    assert ST.vacuum(spark, root, grace_seconds=0) >= 0
    assert rows(ST.read_snapshot(spark, root, "20240201")) == rows(lib)
    for day in range(2, 8):
        ST.snapshot(spark, root, f"2024-02-{day:02d} 00:00:00")
    assert ST.snapshots(spark, root) == [f"202402{d:02d}" for d in range(3, 8)]
    assert ST.vacuum(spark, root, grace_seconds=3600) == 0  # young folders may belong to a running commit
    assert ST.vacuum(spark, root, grace_seconds=0) >= 2  # the bucket and counts that only the first snapshot named
    assert ST.read(spark, root).where("hidden").count() == lib.where("hidden").count() + 1
    assert rows(ST.read_snapshot(spark, root, "20240207")) == rows(ST.read(spark, root))


def test_newest_opens_few_buckets(spark, root):
    lib = library(spark, 95)
    ST.create(lib, root, bucket_rows=10, link_buckets=4)
    top = ST.newest(spark, root, 8)
    assert top.collect() == L.library_top(lib, None, 8).collect()
    assert len({f.split("/")[-2] for f in top.inputFiles()}) <= 2
    for category, n in (("a", 7), ("b", 200), ("none", 3)):
        assert ST.newest(spark, root, n, category).collect() == L.library_top(lib, category, n).collect()


def test_renames_fold_and_touch_only_their_buckets(spark, root):
    lib = library(spark).withColumn("category", F.when(F.col("id") < 10, "old").otherwise(F.col("category")))
    one = ST.create(lib, root, bucket_rows=10, link_buckets=4)
    two = ST.rename_categories(spark, root, [("old", "mid"), ("mid", "a")])
    assert {b for b in two.data if two.data[b] != one.data[b]} == {"0"}
    assert rows(ST.read(spark, root)) == rows(V.rename_categories(lib, [("old", "mid"), ("mid", "a")]))
    counts_hold(spark, root)


def test_rejects_are_stored_once_with_their_attempts(spark, root):
    ST.create(library(spark, 20), root, bucket_rows=10, link_buckets=4)
    bad = spark.createDataFrame([("x", "no length"), ("x", "another"), ("y", "no model")], "link string, problem string")
    for _ in range(2):
        ST.append(items(spark, ["n1"]), root, AS_OF, failed=bad)
    got = {r.link: (r.stage, r.attempts, r.problem) for r in ST.rejects(spark, root).collect()}
    assert got == {"x": ("import", 2, "another"), "y": ("import", 2, "no model")}
    ST.append(items(spark, ["y"]), root, AS_OF, failed=bad.where("link = 'x'"))  # y can be stored at last
    assert [(r.link, r.attempts) for r in ST.rejects(spark, root).collect()] == [("x", 3)]


def test_empty_library(spark, root):
    ST.create(library(spark, 0), root)
    assert ST.read(spark, root).count() == 0 and ST.newest(spark, root).count() == 0
    ST.append(items(spark, ["a"]), root, AS_OF)
    assert [r.id for r in ST.read(spark, root).collect()] == [1]


def test_an_update_shuffles_no_stored_row_and_writes_small_filters(spark, tmp_path):
    root = str(tmp_path / "store")
    ST.create(X.library(spark, SF_SMALL), root, bucket_rows=20, link_buckets=2)
    first = ST.open_version(spark, root)
    ids = [r.id for r in ST.read(spark, root).select("id").collect()][::3]
    done = ST.update(spark.createDataFrame([(i, "new") for i in ids], "id bigint, summary string"), ["summary"], root)
    rows = {r.id: r.summary for r in ST.read(spark, root).collect()}
    before = {r.id: r.summary for r in ST.read(spark, root, first).collect()}
    assert rows == {i: "new" if i in set(ids) else s for i, s in before.items()}
    files = [f for own in done.data.values() for folder in own for f in (tmp_path / "store" / folder).glob("*.parquet")]
    assert len(files) == len(done.data) and sum(f.stat().st_size for f in files) < 2 ** 20
