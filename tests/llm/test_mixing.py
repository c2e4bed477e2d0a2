import duckdb
from pyspark.sql import functions as F

from reelhouse.llm import mixing
from tests.llm.helpers import ODD, documents, random_texts, words


def rows():
    texts = random_texts(80, 2) + ODD
    out = [(i, t, [None, "b", "a", "Z", "é", ""][i % 6]) for i, t in enumerate(texts)]
    return out + [(None, "W1 W2", "b"), (7, "W1", "a"), (7, "W1", "a"), (900, "", "empty")]


def test_mix_matches_its_sql(spark):
    df = documents(spark, rows())
    documents_ = df.toPandas()[["doc_id", "text", "source"]]  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.register("documents", documents_.astype({"doc_id": "Int64"}))
    want = sorted(map(str, con.execute(mixing.MIX_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in mixing.mix(df).drop("n_servings").collect()) == want


def test_targets_and_limits(spark):
    got = mixing.mix(documents(spark, rows())).collect()
    total = sum(r["size"] for r in got)
    per = {}
    for r in got:
        assert r.taken <= 2 * r["size"]
        key = (r.source_size, r.target)
        per[key] = per.get(key, 0) + r.taken
    for (size, target), taken in per.items():
        assert target <= 2 * size and abs(taken - target) <= 1
    assert abs(sum(t for _, t in per) - 1.5 * total) < 1e-6


def test_reruns_agree_and_weights_matter(spark):
    df = documents(spark, [r for r in rows() if len(r[1] or "") < 2000])
    a = sorted(map(str, mixing.mix(df).collect()))
    assert a == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert a != sorted(map(str, mixing.mix(df, weights=(1.0, 5.0)).collect()))


def test_empty_table_and_wordless_table(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    got = mixing.mix(documents(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_mixed_documents_hold_the_words_taken(spark):
    df = documents(spark, rows())
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == [*df.columns, "mix_position"]
    taken = {}
    for r in mixing.mix(df).where(F.col("taken") > 0).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == taken
    positions = sorted(r.mix_position for r in mixed.collect())
    assert positions == list(range(len(positions)))
