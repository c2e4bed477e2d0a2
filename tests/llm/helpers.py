"""Small fixtures and brute force for the training-data operators."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, lower=False):
    return WORD.findall(fold(text) if lower else text or "")


def shingles(text):
    w = words(text, True)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def documents(spark, rows):
    """Rows (doc_id, text, source) as a table with more columns, some with names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 2.0) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "blob string, size int, n double")


def random_texts(n, seed, vocabulary=60, longest=80):
    r = random.Random(seed)
    names = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(vocabulary)]
    return [r.choice([" ", "\n", "  ", "\t"]).join(r.choice(names) for _ in range(r.randrange(longest))) for _ in range(n)]


#: Null, empty, blank, tiny and odd texts.
ODD = [None, "", " \n\t ", "one", "a b c d", "a b c d e", "\x85   ", "é日𝒳 " * 9, "x" * 70000, "ab 1 " * 4000]


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


def alike_modulo_a_power_of_two(n=1024, letters="ab"):
    """Two strings whose polynomials agree modulo 2**64 for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)
