import random
from collections import Counter

import pyarrow as pa

from reelhouse.llm import repetition
from tests.llm.helpers import ODD, alike_modulo_a_power_of_two, documents, random_texts, words


def repeated_texts():
    r = random.Random(6)
    out = []
    for n in range(60):
        lines = [" ".join(r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.randrange(12))) for _ in range(r.randrange(12))]
        out.append("\n".join(lines + [r.choice(lines or ["x"]) for _ in range(n % 9)]) + r.choice(["", "\n", " #$%"]))
    return out


def covered(w, n, later_only=False):
    grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
    count, seen, out = Counter(grams), set(), set()
    for i, g in enumerate(grams):
        if count[g] > 1 and (g in seen or not later_only):
            out.update(range(i, i + n))
        seen.add(g)
    return out


def test_measures_match_brute_force(spark):
    texts = repeated_texts() + random_texts(10, 7, vocabulary=6, longest=300) + ODD
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in repetition.repetition(df).collect()}
    for i, t in enumerate(texts):
        w, t, seen, lines = words(t), t or "", set(), 0
        for line in t.split("\n"):
            if words(line):
                lines += line in seen
                seen.add(line)
        r, repeat = got[i], len(covered(w, 8))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), lines, repeat), t[:80]
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        for n in (5, 6, 7, 8, 9, 10):
            assert r[f"dup_chars_{n}"] == sum(len(w[k]) for k in covered(w, n, True)), (n, t[:80])
        assert r.base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_clean_and_repetitive_texts(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    line = "this short line is said twice in the text"
    df = documents(spark, [(1, clean, "s"), (2, f"{line}\n{clean}\n{line}", "s"), (3, f"{clean} {clean}", "s"),
                           (4, "\n".join([clean] * 5), "s"), (None, clean, None), (None, clean, None)])
    kept = Counter(r.doc_id for r in repetition.keep_good(df).collect())
    assert kept == {1: 1, 2: 1, None: 2}
    verdict = Counter(r.doc_id for r in repetition.repetition(df).where("kept").collect())
    assert verdict == kept
    assert repetition.keep_good(df).columns == df.columns


def top_covered(w, n):
    grams, count, first = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)], Counter(), {}
    for i, g in enumerate(grams):
        count[g] += 1
        first.setdefault(g, i)
    some = [g for g in count if count[g] >= 3]
    if not some:
        return set()
    top = max(some, key=lambda g: (count[g] * sum(map(len, g)), -first[g]))
    return {k for i, g in enumerate(grams) if g == top for k in range(i, i + n)}


def test_top_ngrams_match_brute_force(spark):
    texts = repeated_texts() + random_texts(30, 17, vocabulary=6, longest=300) + ODD + ["a " * 50, "b b b", "c c"]
    got = {r.doc_id: r for r in repetition.repetition(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        for n in (2, 3, 4):
            assert got[i][f"top_chars_{n}"] == sum(len(w[k]) for k in top_covered(w, n)), (n, t and t[:80])


def test_short_phrases_and_boilerplate_lines(spark):
    phrase = " ".join(f"click here to buy item{i}" for i in range(100))
    clean = [" ".join(f"word{i}x{k}" for k in range(4)) for i in range(30)]
    lines = "\n".join(x for i, c in enumerate(clean) for x in ([c, "read more"] if i % 5 < 4 else [c]))  # 23 of 54 lines
    function = " ".join(f"of the noun{i} and verb{i} it was adjective{i} then adverb{i}" for i in range(40))
    once = "\n".join([*clean[:8], clean[0]])  # a line said twice
    ends = "first line of it\n" + "\n".join(clean[:1]) + "\n" + " ".join(clean[1:6]) + "\nfirst line of it"
    df = documents(spark, [(1, phrase, "s"), (2, lines, "s"), (3, function, "s"), (4, once, "s"), (5, ends, "s")])
    assert {r.doc_id for r in repetition.keep_good(df).collect()} == {3, 4, 5}
    assert {r.doc_id for r in repetition.repetition(df).where("kept").collect()} == {3, 4, 5}


def test_empty_table(spark):
    assert repetition.repetition(documents(spark, [])).collect() == []
    assert repetition.keep_good(documents(spark, [])).collect() == []


def test_long_lines_that_a_polynomial_confuses():
    x, y = alike_modulo_a_power_of_two()
    got = repetition.measure(pa.array([f"{x}\n{y}", f"{x}\n{y}\n{x}"]), repetition.Limits())
    assert got["n_dup_lines"].tolist() == [0, 1]
