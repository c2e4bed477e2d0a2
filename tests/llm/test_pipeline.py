from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from reelhouse.llm import bpe, queries
from reelhouse.llm.common import written
from tests.conftest import SF_SMALL
from tests.llm.helpers import shingles, words
from tests.llm.test_ledger import base
from tests.llm.test_repetition import covered


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert set(queries.SQL) <= set(names)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    held, results = docs, []
    for name, stage in corpus_pipeline.STAGES:
        held = written(stage(spark, held, SF_SMALL), "test-stage")
        results.append(held)
    for out in results[:-1]:
        assert out.columns == docs.columns
    good, lone, clean, mixed, ids = ([r for r in x.collect()] for x in results)

    text = {r.doc_id: r.text for r in docs.collect()}
    passes = {d for d, t in text.items() if len(words(t)) >= 20 and 100 * len(covered(words(t), 8)) <= 30 * len(words(t))}
    assert {r.doc_id for r in good} <= passes and len(good) >= 0.97 * len(passes)

    sets = {r.doc_id: shingles(r.text) for r in good}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    up = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and near(sets[a], sets[b]):
                low, high = sorted((up[a], up[b]))
                up = {d: low if u == high else u for d, u in up.items()}
    assert sorted(r.doc_id for r in lone) == sorted(d for d, u in up.items() if d == u)

    assert {r.doc_id for r in clean} == {r.doc_id for r in lone}
    for r in clean:
        before = text[r.doc_id]
        assert (r.text == before) == (not base(before)) and not base(r.text.replace("[secret]", ""))
        assert r.n_chars == len(r.text)

    size = {r.doc_id: len(words(r.text)) for r in clean}
    assert sum(len(words(r.text)) for r in mixed) == pytest.approx(1.5 * sum(size.values()), abs=25)
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 2
    kept = {r.doc_id: r.text for r in clean}
    assert all(kept[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mixed)

    enc = bpe.encoding(corpus_pipeline.RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids) == Counter((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in mixed)


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = docs.limit(3).union(docs.limit(1)).union(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    for some in (docs.limit(0), odd):
        held = some
        for name, stage in corpus_pipeline.STAGES:
            held = written(stage(spark, held, SF_SMALL), "test-stage")
        assert held.count() >= 0 and "doc_id" in held.columns


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count() > 0 and out.where(F.size("ids") != F.col("n_tokens")).count() == 0
