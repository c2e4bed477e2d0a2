"""Vocabulary, renames, updates, views and snapshots."""

import os
import tempfile

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelhouse.operators import library as L
from reelhouse.operators import snapshots as S
from reelhouse.operators import updates as U
from reelhouse.operators import vocabulary as V
from reelhouse.sources import fixtures as X
from tests.conftest import SF_SMALL, col_values


def test_configured_and_candidates(spark):
    conf = V.configured_categories(spark, "cat_en, News ,,Music")
    assert sorted(col_values(conf)) == ["Music", "News", "cat_en"]
    lib = spark.createDataFrame([(1, "uncategorized"), (2, "Film"), (3, None)], "id bigint, category string")
    assert sorted(col_values(V.candidate_vocabulary(conf, lib))) == ["Film", "Music", "News", "cat_en"]
    assert col_values(V.vocabulary_text(V.candidate_vocabulary(conf, lib))) == ["Film\nMusic\nNews\ncat_en"]


def _sequential(cats, renames):
    cats = list(cats)
    for old, new in renames:
        if new:
            cats = [new if c == old else c for c in cats]
    return cats


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABCD"), st.sampled_from(["", "A", "B", "C", "D", "E"])),
                max_size=6),
       st.lists(st.sampled_from("ABCDE"), min_size=1, max_size=8))
def test_rename_fold_equals_sequential(renames, cats):
    final = V.fold_renames(renames)
    assert [final.get(c, c) for c in cats] == _sequential(cats, renames)


def test_rename_join(spark):
    lib = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "id bigint, category string")
    out = V.rename_categories(lib, [("A", "B"), ("B", "C"), ("C", "")])
    assert sorted((r.id, r.category) for r in out.collect()) == [(1, "C"), (2, "C"), (3, "C"), (4, None)]


def test_updates_write_null(spark):
    lib = spark.createDataFrame([(1, "s1", False), (2, "s2", False)], "id bigint, summary string, hidden boolean")
    ch = spark.createDataFrame([(2, None)], "id bigint, summary string")
    out = {r.id: r.summary for r in U.apply_updates(lib, ch, ["summary"]).collect()}
    assert out == {1: "s1", 2: None}
    flags = spark.createDataFrame([(1, True)], "id bigint, hidden boolean")
    assert {r.id: r.hidden for r in U.set_hidden(lib, flags).collect()} == {1: True, 2: False}


def test_views_on_fixture(spark):
    lib = X.library(spark, SF_SMALL)
    counts = L.category_counts(lib).collect()
    assert all(r.label == f"{r.category} ({r.n})" for r in counts)
    view = L.library_view(lib, None, X.AS_OF).collect()
    assert len(view) == 50 and sum(r.expanded for r in view) == 1
    top = max(view, key=lambda r: r.id)
    assert top.expanded


def test_retention(spark):
    m = spark.createDataFrame([(f"2024010{i}",) for i in range(1, 7)], "snapshot_date string")
    out = {r.snapshot_date: r.keep for r in S.expired_snapshots(m, 5).collect()}
    assert [d for d, k in sorted(out.items()) if not k] == ["20240101"]


def test_publish_and_snapshot(spark):
    root = tempfile.mkdtemp(prefix="reelhouse-test-")
    lib = spark.createDataFrame([(1, "a")], "id bigint, link string")
    S.publish(lib, f"{root}/v", check=False)
    S.publish(lib.union(spark.createDataFrame([(2, "b")], "id bigint, link string")), f"{root}/v", check=False)
    assert S.read_latest(spark, f"{root}/v").count() == 2
    for day in range(1, 8):
        S.snapshot(lib, f"{root}/snaps", f"2024-01-0{day} 10:00:00")
    assert S.snapshot(lib, f"{root}/snaps", "2024-01-07 23:00:00") is None   # today's exists
    kept = sorted(os.listdir(f"{root}/snaps"))
    assert kept == [f"snapshot_date=2024010{d}" for d in range(3, 8)]


def test_the_last_change_of_an_id_wins(spark):
    lib = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True)], "id bigint, summary string, hidden boolean")
    ch = spark.createDataFrame([(1, "z", 1), (1, "b", 3), (1, "y", 2), (2, "x", 1), (2, None, 2), (9, "q", 1)],
                               "id bigint, summary string, ord int")
    out = sorted((r.id, r.summary) for r in U.apply_updates(lib, ch, ["summary"], "ord").collect())
    assert out == [(1, "b"), (2, None), (3, "c")]     # one row per id; a NULL change still wins
    flags = spark.createDataFrame([(1, True, 1), (1, False, 2), (2, False, 1), (2, True, 2)], "id bigint, hidden boolean, ord int")
    assert {r.id: r.hidden for r in U.set_hidden(lib, flags, "ord").collect()} == {1: False, 2: True, 3: True}


def test_repeated_changes_need_an_order(spark):
    lib = spark.createDataFrame([(1, "a")], "id bigint, summary string")
    ch = spark.createDataFrame([(1, "x"), (1, "y")], "id bigint, summary string")
    with pytest.raises(Exception, match="without an order column"):
        U.apply_updates(lib, ch, ["summary"]).collect()


def test_publish_checks_the_rules_and_prunes(spark):
    root = tempfile.mkdtemp(prefix="reelhouse-test-")
    lib = X.library(spark, SF_SMALL)
    for _ in range(4):
        S.publish(lib, root, keep=2)
    assert sorted(d for d in os.listdir(root)) == ["v=2", "v=3"]
    with pytest.raises(ValueError, match="link is not unique"):
        S.publish(lib.unionByName(lib.limit(2)), root)
    assert S.latest_version(spark, root) == 3 and not os.path.exists(f"{root}/v=4")


def test_attempts_leave_the_queue(spark):
    lib = spark.createDataFrame([(1, None, False), (2, None, False), (3, "x", False)], "id bigint, subtitles string, hidden boolean")
    tries = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    assert {r.id for r in L.queue_subtitles(lib).collect()} == {1, 2}
    assert {r.id for r in L.queue_subtitles(lib, tries).collect()} == set()
    assert {r.id for r in L.queue_subtitles(lib, tries, most=2).collect()} == {2}
