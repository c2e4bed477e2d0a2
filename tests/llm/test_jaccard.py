import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelhouse.llm import jaccard
from reelhouse.llm.components import components
from tests.llm.helpers import ODD, alike_modulo_a_power_of_two, documents, random_texts, shingles


def linked(a, b):
    both = len(a & b)
    return bool(a) and 100 * both >= 80 * (len(a) + len(b) - both)


def brute(rows):
    """(links between different sets, component of every row)."""
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                pairs += sets[i] != sets[j]
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return pairs, Counter((d, len(s), least[root(i)] if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets)))


def edited(words, share, r):
    return [f"e{r.random()}" if r.random() < share else w for w in words]


def rows(seed=9):
    r = random.Random(seed)
    texts = random_texts(25, seed) + ODD
    passage = [f"p{i}" for i in range(60)]
    for g in range(8):  # groups of copies, some with many members, and documents that share a passage
        own = [f"g{g}w{i}" for i in range(r.choice([6, 40, 150]))] + (passage if g % 2 else [])
        for k in range(r.choice([2, 3, 25])):
            texts.append(" ".join(own if k % 4 == 0 else edited(own, r.choice([0.005, 0.02, 0.04]), r)))
    out = [(i, t, "s") for i, t in enumerate(texts)]
    out += [(None, texts[-1], None), (3, texts[-1], "s"), (3, "lone text of the id three", "s"), (3, texts[-1].upper(), "s")]
    return out


@pytest.mark.parametrize("leaf", [1, 6, 128])
def test_components_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rows_ = rows(10 + leaf)
    got = jaccard.near_duplicates(documents(spark, rows_)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows_)[1]


@pytest.mark.parametrize("leaf", [3, 128])
def test_all_links_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rows_ = rows(12)
    by_set = {frozenset(shingles(t)): t for _, t, _ in rows_}  # one text a set
    one = [(i, t, "s") for i, t in enumerate(by_set.values())]
    points = jaccard.cells_of(jaccard.points_of(documents(spark, one), "doc_id", "text").where("n > 0"))
    found = jaccard.links(points, all_links=True).select(F.least("a", "b"), F.greatest("a", "b")).distinct().count()
    assert found == brute(one)[0]


def test_one_of_each_group_stays(spark):
    rows_ = rows(13)
    df = documents(spark, rows_)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    sets = [shingles(t) for t in set(texts) if t]  # rows equal in id and text stay together
    assert not any(linked(a, b) for i, a in enumerate(sets) for b in sets[:i])
    alone = [t for i, (_, t, _) in enumerate(rows_) if not any(
        linked(shingles(t), shingles(u)) for k, (_, u, _) in enumerate(rows_) if k != i)]
    assert not Counter(alone) - Counter(texts)


def test_one_row_of_equal_rows_stays(spark):
    r = random.Random(14)
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(4)]
    near = " ".join([*texts[3].split(), "more"])
    rows_ = [(7, texts[0], "a")] * 30 + [(None, texts[1], "b")] * 20 + [(1, texts[2], "s"), (None, texts[2], "s"), (1, texts[2], "s")]
    rows_ += [(5, texts[3], "s"), (4, near, "s"), (4, near, "s")] + [(8, "", "s"), (8, "", "s"), (None, None, "s")]
    r.shuffle(rows_)
    got = Counter((x.doc_id, x.text) for x in jaccard.keep_one(documents(spark, rows_).repartition(5)).collect())
    assert got == {(7, texts[0]): 1, (None, texts[1]): 1, (1, texts[2]): 1, (4, near): 1, (8, ""): 2, (None, None): 1}


def test_one_row_of_each_component_stays(spark):
    rows_ = rows(15)
    rows_ += rows_[::3]
    groups = {g: n for g, n in brute(rows_)[1].items() if g[1] == 0}  # texts without words all stay
    _, by_component = brute([(k, t, s) for k, (_, t, s) in enumerate(rows_)])  # ids by row: one component each
    kept = jaccard.keep_one(documents(spark, rows_)).collect()
    assert len(kept) == len({c for _, n, c in by_component if n}) + sum(groups.values())


def test_large_group_of_near_copies(spark):
    r = random.Random(5)
    own = [f"w{i}" for i in range(120)]
    rows_ = [(i, " ".join(own[:k] + ["x"] * bool(i) + own[k:]), "s") for i in range(400) for k in [r.randrange(120)]]
    got = jaccard.near_duplicates(documents(spark, rows_)).collect()
    assert {r.component_id for r in got} == {0}


def test_empty_tables(spark):
    assert jaccard.near_duplicates(documents(spark, [])).collect() == []
    got = jaccard.near_duplicates(documents(spark, [(1, None, "s"), (2, "", "s")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2)}


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(300, 200), (200, 250), (250, 300), (400, 400)]
    r.shuffle(links)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 151)}, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_words_that_a_polynomial_confuses(spark):
    x, y = alike_modulo_a_power_of_two()
    got = jaccard.near_duplicates(documents(spark, [(1, f"p q {x}", "s"), (2, f"p q {y}", "s"), (3, f"P q {x}", "s")]))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 1}
