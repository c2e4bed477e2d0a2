import dataclasses
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelhouse.llm import hmm
from tests.llm.helpers import ODD, documents, random_texts, words


def table(spark):
    texts = random_texts(60, 1) + ODD
    return documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "W1 W2 nie", None), (3, "W5", "s"), (3, "W5", "s")])


def test_base_score_and_counts_match_brute_force(spark):
    df = table(spark)
    rows = [(r.doc_id, [*words(r.text, True), None]) for r in df.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows for w in t if not out(i))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), out(i), len(t), sum(w in count for w in t), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in rows)
    got = hmm.language_model_scores(df, rounds=1).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_empty_table_and_no_training_text(spark):
    assert hmm.language_model_scores(documents(spark, []), rounds=1).collect() == []
    df = documents(spark, [(1, "a b", "s"), (2, None, "s")])
    got = {r.doc_id: r for r in hmm.language_model_scores(df, held=F.lit(True)).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[2].n_tokens == 1


def plain_likelihood(model, seq):
    state, total = model.start * model.emit[seq[0]], 0.0
    for g in seq[1:]:
        total += math.log(state.sum())
        state = (state / state.sum()) @ model.move * model.emit[g]
    return total + math.log(state.sum())


def random_model(states, classes, seed):
    r = np.random.default_rng(seed)
    rows = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(r.random(s) + 0.05)
    return hmm.Model(rows(states), rows(states, states), rows(states, classes).T)


def test_likelihood_matches_the_plain_recursion_and_sums_to_one():
    model = random_model(3, 5, 0)
    r = np.random.default_rng(1)
    sizes = np.array([1, 40, 7, 7, 300, 2])
    seqs = [r.integers(0, 5, n) for n in sizes]
    got = hmm.log_likelihood(np.concatenate(seqs), sizes, model)
    assert np.allclose(got, [plain_likelihood(model, s) for s in seqs])
    every = np.array(np.meshgrid(*[range(5)] * 4)).reshape(4, -1).T
    total = np.exp(hmm.log_likelihood(every.ravel(), np.full(len(every), 4), model)).sum()
    assert total == pytest.approx(1.0)


def test_expected_counts_match_enumeration():
    model = random_model(2, 3, 2)
    seq = np.array([0, 2, 1, 1, 0])
    starts, moves, emits, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
    for path in np.array(np.meshgrid(*[range(2)] * 5)).reshape(5, -1).T:
        p = model.start[path[0]] * np.prod([model.emit[g, k] for g, k in zip(seq, path)]) * np.prod(
            [model.move[a, b] for a, b in zip(path, path[1:])])
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for g, k in zip(seq, path):
            emits[g, k] += p
    # a second, shorter sequence beside it must not disturb the counts
    one = hmm.expected_counts(seq, np.array([5]), model)
    for got, want in zip(one, (starts, moves, emits)):
        assert np.allclose(got, want / total, atol=1e-4)
    two = hmm.expected_counts(np.concatenate([[1], seq]), np.array([1, 5]), model)
    alone = hmm.expected_counts(np.array([1]), np.array([1]), model)
    for a, b, c in zip(one, alone, two):
        assert np.allclose(a + b, c, atol=1e-4)


@pytest.mark.parametrize("window", [1, 3, 64])
def test_windows_change_neither_likelihood_nor_counts(monkeypatch, window):
    model = random_model(3, 5, 4)
    r = np.random.default_rng(5)
    sizes = np.array([1, 200, 3, 64, 65, 2, 128])
    symbols = r.integers(0, 5, sizes.sum())
    names = r.integers(0, 9, sizes.sum())
    whole = hmm.log_likelihood(symbols, sizes, model), *hmm.expected_counts(symbols, sizes, model, names, 9)
    monkeypatch.setattr(hmm, "WINDOW", window)
    monkeypatch.setattr(hmm, "GROUP", 100)
    cut = hmm.log_likelihood(symbols, sizes, model), *hmm.expected_counts(symbols, sizes, model, names, 9)
    for a, b in zip(whole, cut):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-3)
    assert cut[1].sum() == pytest.approx(len(sizes), rel=1e-4)
    assert cut[2].sum() == pytest.approx((sizes - 1).sum(), rel=1e-4)


def test_a_very_long_text_takes_few_steps():
    model = random_model(4, 50, 6)
    symbols = np.random.default_rng(7).integers(0, 50, 1_000_000)
    begin = time.process_time()
    got = hmm.log_likelihood(symbols, np.array([len(symbols)]), model)
    assert time.process_time() - begin < 20
    assert got[0] == pytest.approx(plain_likelihood(model, symbols[:1000].tolist()) * 1000, rel=0.05)


def test_word_emissions_sum_to_one(spark):
    words_ = hmm.Words(random_model(3, 6, 8), 100, 4, np.array([40.0, 30.0, 30.0]), 10)
    shares = np.array([[.5, .2, .3], [.1, .6, .3], [.4, .3, .3], [.45, .15, .4]])
    known = np.array([50, 20, 20, 10])
    by_state = (known[:, None] * np.rint(shares * hmm.WHOLE) / hmm.WHOLE).sum(0)
    words_ = dataclasses.replace(words_, by_state=by_state)
    emit = words_.emissions(np.append(known, 0), np.vstack([np.rint(shares * hmm.WHOLE), np.zeros(3)]))
    assert np.allclose(emit.sum(0), 1.0)  # four words, one unseen, the end


def test_untied_round_counts_every_word_by_state(spark):
    df = table(spark)
    rows = hmm.blocks(df, "doc_id", "text", F.lit(False))
    model = hmm.train(rows, hmm.class_totals(rows, 64), 3, 1)
    found = hmm.untied(hmm.word_counts(rows, model), model, 0)
    every = [w for r in df.collect() for w in words(r.text, True)]
    assert (found.tokens, found.distinct) == (len(every), len(set(every)))
    assert found.by_state.sum() == pytest.approx(len(every), rel=1e-3)


def test_states_learn_and_held_out_text_scores_better(spark):
    r = np.random.default_rng(3)
    tongues = [[f"{p}{i}" for i in range(300)] for p in ("a", "b", "c")]
    texts = [" ".join(r.choice(tongues[i % 3], 60)) for i in range(240)]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = [x for x in hmm.language_model_scores(df, states=4, rounds=6).collect() if x.held_out]
    assert got and sum(x.score for x in got) > sum(x.base_score for x in got) + 0.2 * sum(x.n_tokens for x in got)
