import random

import numpy as np
import pyarrow as pa
import pytest

from reelhouse.llm import kernel
from tests.llm.helpers import alike_modulo_a_power_of_two, words

ALPHABET = " \t\n\x0b\x0c\r aabBcé日\x85 "


@pytest.mark.parametrize("piece", [3, 7, 50, 1 << 20])
def test_words_lines_and_shingles_match_plain_python(piece):
    r = random.Random(piece)
    seen, seen_lines = {}, {}
    for _ in range(60):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.choice([0, 1, 3, 10, 40]))) for _ in range(6)]
        data, offsets = kernel.utf8(pa.array([*texts, None]))
        hashes, first = kernel.words(data, offsets, True, piece)
        plain = [words(t, True) for t in [*texts, ""]]
        assert list(np.diff(first)) == [len(w) for w in plain]
        for word, h in zip((w for t in plain for w in t), hashes.tolist()):
            assert seen.setdefault(word, h) == h
        line, worded, chars, owner = kernel.lines(data, offsets)
        want = [(i, x) for i, t in enumerate([*texts, ""]) for x in t.split("\n")]
        assert list(owner) == [i for i, _ in want]
        assert list(chars) == [len(x) for _, x in want]
        assert list(worded) == [bool(words(x)) for _, x in want]
        for (_, x), h in zip(want, line.tolist()):
            assert seen_lines.setdefault(x, h) == h
        for w, s in zip(plain, kernel.shingle_sets(hashes, first, 3)):
            assert len(s) == len({tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    assert len(set(seen.values())) == len(seen)
    assert len(set(seen_lines.values())) == len(seen_lines)


def test_sliced_columns_and_long_texts():
    column = pa.array(["a", "b " * 100000, None, "c d"]).slice(1, 3)
    hashes, first = kernel.words(*kernel.utf8(column), piece=1000)
    assert list(np.diff(first)) == [100000, 0, 2]
    assert len(set(hashes.tolist())) == 3


@pytest.mark.parametrize("n", [16, 64, 65, 512, 1024, 4096])
def test_long_segments_that_a_polynomial_confuses(n):
    x, y = alike_modulo_a_power_of_two(n)
    hashes, _ = kernel.words(*kernel.utf8(pa.array([f"{x} {y} {x.upper()} {x}"])), fold=True)
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2] == hashes[3]
    line, *_ = kernel.lines(*kernel.utf8(pa.array([f"{x}\n{y}\n{x}"])))
    assert line[0] != line[1] and line[0] == line[2]
