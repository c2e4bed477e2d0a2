import hashlib

import numpy as np
import pyarrow as pa
import pytest

from reelhouse.llm import sketch
from tests.llm.helpers import ODD, documents, random_texts, shingles


def by_id(spark, rows):
    return {r.doc_id: r for r in sketch.compare_with_next(documents(spark, rows)).collect()}


def test_edits_and_next_documents_match_brute_force(spark):
    texts = random_texts(150, 14, vocabulary=2000, longest=200) + ODD + ["same text here to see"] * 3
    rows = [(7 * i - 300, t, "s") for i, t in enumerate(texts)]
    got = by_id(spark, rows[::-1])
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edit = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r, marks = got[i], [sketch.from_text(got[j].fingerprint) for j in (i, rows[(k + 1) % len(rows)][0])]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert r.edited_fingerprint == sketch.to_text(sketch.sketches(pa.array([edit]))[0])
        assert r.near_edited == sketch.likeness(marks[0], sketch.from_text(r.edited_fingerprint))
        assert r.near_next == sketch.likeness(*marks)
        assert r.contain_edited == sketch.containment(marks[0], sketch.from_text(r.edited_fingerprint))
        assert r.contain_next == sketch.containment(*marks)
    assert len({r.fingerprint for r in list(got.values())[:3]}) >= 1


def test_ties_nulls_and_single_rows(spark):
    df = documents(spark, [(1, "b", "s"), (1, "a", "s"), (None, "n", "s"), (2, "c", "s")])
    got = {(r.doc_id, r.fingerprint): r.near_next for r in sketch.compare_with_next(df).collect()}
    assert len(got) == 4
    one = sketch.compare_with_next(documents(spark, [(5, "a b c d e f", "s")])).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest()
    assert len(sketch.compare_with_next(documents(spark, [(None, "a", "s"), (None, "b", "s")])).collect()) == 2
    assert sketch.compare_with_next(documents(spark, [])).collect() == []
    assert sketch.fingerprints(documents(spark, [])).collect() == []


def test_equal_texts_have_equal_fingerprints_and_estimates_are_close(spark):
    texts = random_texts(6, 15, vocabulary=5000, longest=4000)
    texts = [t + " " + " ".join(f"z{i}{k}" for i in range(3000)) for k, t in enumerate(texts)]
    marks = [r.fingerprint for r in sketch.fingerprints(documents(spark, [(i, t, "s") for i, t in enumerate(texts + texts)])).orderBy("doc_id").collect()]
    assert marks[:6] == marks[6:]
    a, b = texts[0], texts[0][: len(texts[0]) // 2] + texts[1]
    x, y = sketch.sketches(pa.array([a, b]))
    sa, sb = shingles(a), shingles(b)  # these texts are lower-case but for their words' initials
    assert sketch.likeness(x, y) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.06)
    assert sketch.containment(x, y) == pytest.approx(len(sa & sb) / len(sa), abs=0.08)


def test_merging_is_the_fingerprint_of_both():
    texts = random_texts(30, 16, longest=60)
    for a, b in zip(texts, texts[1:]):
        x, y = sketch.sketches(pa.array([a, b]))
        both = np.union1d(x, y)
        merged = sketch.merge(x, y)
        low = both[both < np.uint64(sketch.kernel.MASK // sketch.SCALE)]
        assert list(merged) == list(low if len(low) else both[:1])


def test_empty_fingerprints():
    empty, some = np.empty(0, "<u8"), np.array([1], "<u8")
    assert sketch.likeness(empty, empty) == 1.0 and sketch.likeness(empty, some) == 0.0
    assert sketch.containment(empty, some) == 1.0 and list(sketch.from_text(sketch.to_text(some))) == [1]
