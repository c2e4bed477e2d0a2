import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reelhouse.llm import pairwise
from reelhouse.llm.kernel import utf8
from tests.llm.helpers import ODD, documents, random_texts

COLUMNS = ["doc_id", "held_out", "score", "predicted"]


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, quality int, toxic int, score string")


def of(texts):
    return pairwise.measures(*utf8(pa.array(texts, pa.string())))


def test_measures_by_hand():
    text = "A a b! ##\na a b! 7\n\nlong, words"
    got = of([text, None, "x x x x"])
    names = ["upper", "digit", "stop", "shout", "sign", "other", "high"]
    solid = sum(not c.isspace() for c in text)
    for k, chars in zip(names, ("A", "7", ",", "!", "#", "", "")):
        assert got[0, names.index(k)] == pytest.approx(sum(c in chars for c in text) / solid), k
    assert not got[1, :22].any()
    # words that repeat the word before them, distinct words, the commonest word
    assert got[2, 15:18].tolist() == [0.75, 0.25, 1.0]


def test_measures_do_not_depend_on_neighbours():
    texts = random_texts(40, 8) + ODD
    together = of(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(together[i], of([t])[0])


def test_held_out_accuracy(spark):
    """Labels that are not held out teach the given documents' quality."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = pairwise.quality(docs, marks)
    assert got.columns == COLUMNS and got.count() == docs.count()
    rows = got.join(marks, "doc_id").where("held_out").collect()
    right = {mark: [r.predicted == r.quality for r in rows if r.quality == mark] for mark in (0, 1)}
    assert all(sum(r) >= 0.9 * len(r) for r in right.values()) and min(map(len, right.values())) > 5
    order = [(a.score > b.score) for a in rows if a.quality for b in rows if not b.quality]
    assert sum(order) >= 0.97 * len(order)


def junk_and_prose(n, seed):
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(30, 60))]
        rows.append((i, " | ".join(w.upper() + "!!" for w in words) if i % 3 == 0 else " ".join(words), "s"))
        marks.append((i, int(i % 3 != 0)))
    return rows, marks


def test_reruns_agree_and_held_out_labels_teach_nothing(spark):
    rows, marks = junk_and_prose(300, 2)
    first = {r.doc_id: r for r in pairwise.quality(documents(spark, rows), labels(spark, marks)).collect()}
    held = {i for i, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in first.items() if r.held_out} == held
    assert all(first[i].predicted == mark for i, mark in marks)
    wrong = [(i, 1 - mark if i in held else mark) for i, mark in marks]
    again = pairwise.quality(documents(spark, rows[::-1]).repartition(5), labels(spark, wrong[::-1])).collect()
    assert {r.doc_id: r for r in again} == first


def test_odd_texts_ids_and_labels(spark):
    rows, marks = junk_and_prose(60, 3)
    odd = [(None, t, "s") for t in ODD] + [(1000 + i, t, "s") for i, t in enumerate(ODD)] + rows[:5] * 3
    more = [(None, 0), (1, None), (2, 1), (2, 1), (2, 0), (9999, 0)]
    got = pairwise.quality(documents(spark, rows + odd), labels(spark, marks + more)).collect()
    assert len(got) == len(rows + odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_nothing_to_learn_from(spark):
    rows, marks = junk_and_prose(20, 4)
    for few in ([], [(i, 1) for i, _ in marks], [(i, None) for i, _ in marks]):
        got = pairwise.quality(documents(spark, rows), labels(spark, few)).collect()
        assert [(r.score, r.predicted) for r in got] == [(0.5, 0)] * 20
    assert pairwise.quality(documents(spark, []), labels(spark, marks)).collect() == []
