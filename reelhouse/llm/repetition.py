"""Quality rules by repetition coverage (operator 5).

For every whole text: rolling hashes of several n-gram lengths find the n-grams
that occur twice or more, and the characters inside their words, and inside
repeated lines, are measured against all characters of the text.  Of n-grams
too short for that (function words repeat in any text), the one with the most
characters is measured.  All texts of an Arrow slice are hashed and sorted
together in numpy; nothing is shuffled.

Cases: a null text counts as the empty text (no words, fails the base rule);
null ids and repeated rows are kept, one result row each; an empty table gives
an empty result; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse.llm import kernel
from reelhouse.llm.common import text_of, tidy

SLICE = 2 << 20
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: Window length of the base rule.
BASE_N = 8


@dataclass(frozen=True)
class Limits:
    """Largest shares a kept text may have.

    ``top_chars``: characters of words inside the top n-gram, by n, if it
    occurs ``least_top`` times at least; all its occurrences are counted.
    ``ngram_chars``: characters of words inside duplicated n-grams, by n;
    ``line_chars`` and ``lines``: repeated lines, if ``least_lines`` at least
    are; ``one_line_chars``: any repeated lines.  The first occurrence is not
    counted in these.  ``least_lines`` and the limits of ``ngram_chars`` leave
    room for one short line said twice in a text of some sixty words, which
    commonly published limits would reject; those of ``top_chars``,
    ``line_chars`` and ``lines`` are the published ones.
    """

    top_chars: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    least_top: int = 3
    ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15})
    line_chars: float = 0.20
    lines: float = 0.30
    least_lines: int = 2
    one_line_chars: float = 0.30
    min_words: int = 20
    base_repeat_percent: int = 30


def _owned(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return kernel.mix(keys + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the key occurs at least twice, it occurred before)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, again


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside the n-word windows that start at ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _top(keys: np.ndarray, at: np.ndarray, owner: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Starts of the windows that are their text's top n-gram.

    That is the one with the most characters in all its occurrences, ``least``
    at least, and of equal ones the first.
    """
    if not len(keys):
        return at
    order = np.argsort(keys, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    count = np.diff(np.append(head, len(order)))
    first = order[head]
    some = np.flatnonzero(count >= least)
    text, weight = owner[first[some]], count[some] * size[first[some]]
    best = some[np.lexsort((-at[first[some]], weight, text))]
    best = best[np.append(np.diff(owner[first[best]]) != 0, True)] if len(best) else best
    top = np.zeros(len(head), bool)
    top[best] = True
    return at[order[np.repeat(top, count)]]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """The measures of every text of an Arrow column."""
    lengths = limits.ngram_chars
    data, offsets = kernel.utf8(texts)
    word, first, start, end = kernel.words_at(data, offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[end] - points[start]
    out = {"n_words": np.diff(first), "word_chars": _sums(chars, first), "n_symbols": _sums(_SYMBOL[data], offsets)}

    line, worded, line_chars, owner = kernel.lines(data, offsets)
    keys, own = _owned(line, owner)[worded], owner[worded]
    again = _repeated(keys)[1]
    texts_n = len(offsets) - 1
    out["n_lines"] = np.bincount(own, minlength=texts_n)
    out["line_chars"] = np.bincount(own, line_chars[worded], texts_n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(own[again], minlength=texts_n)
    out["dup_line_chars"] = np.bincount(own[again], line_chars[worded][again], texts_n).astype(np.int64)

    text_of_word = np.repeat(np.arange(texts_n), np.diff(first))
    seen: np.ndarray | None = None  # window starts that can repeat at the next length
    upto = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=upto[1:])
    for n in sorted({*lengths, *limits.top_chars, BASE_N}):
        roll, at = kernel.ngrams(word, first, n)
        if seen is not None:  # a window repeats only if the shorter one at its start does
            roll, at = roll[seen[at]], at[seen[at]]
        keys = _owned(roll, text_of_word[at])
        twice, later = _repeated(keys)
        starts = at[twice]
        if n in limits.top_chars:
            top = _top(keys[twice], starts, text_of_word[starts], upto[starts + n] - upto[starts], limits.least_top)
            out[f"top_chars_{n}"] = _sums(np.where(_covered(top, n, len(word)), chars, 0), first)
        if n == BASE_N:
            out["n_repeat_words"] = _sums(_covered(starts, n, len(word)), first)
        if n in lengths:
            out[f"dup_chars_{n}"] = _sums(np.where(_covered(at[later], n, len(word)), chars, 0), first)
        seen = np.zeros(len(word) + 1, bool)
        seen[starts] = True
    return out


def _failed(m, limits: Limits):
    """Whether the base rule rejects a text, by its measures (arrays or columns)."""
    return (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.base_repeat_percent * m["n_words"])


def _bad(m, limits: Limits):
    """Whether the limits reject a text, by its measures (arrays or columns)."""
    bad = m["dup_line_chars"] > limits.one_line_chars * m["line_chars"]
    bad = bad | ((m["n_dup_lines"] >= limits.least_lines) & (
        (m["dup_line_chars"] > limits.line_chars * m["line_chars"]) | (m["n_dup_lines"] > limits.lines * m["n_lines"])))
    for name, shares in (("top_chars", limits.top_chars), ("dup_chars", limits.ngram_chars)):
        for n, share in sorted(shares.items()):
            bad = bad | (m[f"{name}_{n}"] > share * m["word_chars"])
    return bad


def repetition(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Measures of every row, ``base_failed`` and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "line_chars", "n_dup_lines", "dup_line_chars",
             "n_repeat_words", *[f"dup_chars_{n}" for n in sorted(limits.ngram_chars)],
             *[f"top_chars_{n}" for n in sorted(limits.top_chars)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "_text", SLICE):
                got = measure(part.column(1), limits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(got[n].astype(np.int64)) for n in names]], ["_id", *names])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(tidy(run), f"_id {kind}, " + ", ".join(f"{n} bigint" for n in names))
    m = {n: F.col(n) for n in names}
    failed, bad = _failed(m, limits), _bad(m, limits)
    return (found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~bad)
            .withColumnRenamed("_id", id_col))


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, text_col, SLICE):
                m = measure(part.column(part.schema.get_field_index(text_col)), limits)
                yield part.filter(pa.array(~(_failed(m, limits) | _bad(m, limits))))

    return docs.mapInArrow(tidy(run), docs.schema)
