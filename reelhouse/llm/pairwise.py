"""Quality classifier by Bradley-Terry pairwise ranking (operator 13).

A document's worth is a weighted sum of measures of its whole text; of two
documents the one marked good is preferred with the logistic probability of
the difference of their worths.  Pairs join labelled documents of unlike marks
that a hash deals into the same bucket, each row of the larger side with
``PARTNERS`` of the smaller in turn; Newton steps sum the loss's gradient and
curvature over all pairs on Spark, in fixed point, so reruns agree.  The
threshold is a quantile of the labelled documents' worths, the one that tells
the marks apart best; the score is logistic and puts it at ``CUT``.

Every labelled document that is not held out is learnt from, once per id;
labels serve nothing else, and ids, languages and sources are not measured.

Cases: a null text counts as the empty text and has a score as any other; null
ids and repeated rows are kept, one result row each, and null ids are never
learnt from; of unlike labels of one id the mean decides, half and more being
good, and null marks do not count; without a label, or with labels of one kind,
nothing can be learnt: all scores are 0.5; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelhouse.llm import kernel
from reelhouse.llm.common import text_of, tidy, written

#: Score at the threshold.
CUT = 0.7
#: Bytes of text measured together.
SLICE = 2 << 20
#: Labelled documents of a bucket, about.
BUCKET = 2048
#: Pairs that a row of a bucket's larger side enters.
PARTNERS = 8
#: Newton steps, and the ridge that keeps them bounded.
STEPS, RIDGE = 8, 1e-3
#: Quantiles tried as threshold.
QUANTILES = 400
#: Fixed point of summed numbers.
UNIT = float(1 << 24)

# kinds of bytes
_LOWER, _UPPER, _DIGIT, _SPACE, _BREAK, _STOP, _SHOUT, _SIGN, _OTHER, _HIGH, _TAIL = range(11)
_KIND = np.full(256, _OTHER, np.uint8)
for _kind, _bytes in ((_LOWER, range(97, 123)), (_UPPER, range(65, 91)), (_DIGIT, range(48, 58)), (_SPACE, b" \t\x0b\x0c\r"),
                      (_BREAK, b"\n"), (_STOP, b".,;:'\"()-"), (_SHOUT, b"!?"), (_SIGN, b"#*$%&|<>"),
                      (_HIGH, range(192, 256)), (_TAIL, range(128, 192))):
    _KIND[list(_bytes)] = _kind


def held_out(id_col: str) -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _repeats(key: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, occurrences of keys found twice or more, of the commonest key) of each text."""
    if not len(key):
        return (np.zeros(texts),) * 3
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    n, own = np.diff(np.append(starts, len(key))), owner[starts]
    most = np.zeros(texts)
    np.maximum.at(most, own, n)
    return np.bincount(own, minlength=texts), np.bincount(own, np.where(n > 1, n, 0), texts), most


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text: shares of its characters, words, word runs and lines."""
    texts = len(offsets) - 1
    kind = _KIND[data]
    count = np.bincount(_owners(offsets) * 11 + kind, minlength=texts * 11).reshape(texts, 11).astype(float)
    chars = count.sum(1) - count[:, _TAIL]
    solid = chars - count[:, _SPACE] - count[:, _BREAK]
    twice = np.flatnonzero((data[1:] == data[:-1]) & (kind[1:] >= _STOP) & (kind[1:] <= _OTHER))
    word, first, start, end = kernel.words_at(data, offsets)
    n = np.diff(first).astype(float)
    owner = _owners(first)
    size = (end - start).astype(float)
    mean = _share(np.bincount(owner, size, texts), n)
    spread = np.sqrt(np.maximum(_share(np.bincount(owner, size * size, texts), n) - mean * mean, 0))
    head, tail = kind[start], kind[end - 1]

    def words_that(flags: np.ndarray) -> np.ndarray:
        return _share(np.bincount(owner, flags, texts), n)

    distinct, _, top = _repeats(word, owner, texts)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    runs = []
    for length in (2, 3, 5, 8):
        roll, at = kernel.ngrams(word, first, length)
        _, repeated, _ = _repeats(roll, owner[at], texts)
        runs.append(_share(repeated, np.bincount(owner[at], minlength=texts)))
    line, worded, _, line_owner = kernel.lines(data, offsets)
    lines = np.bincount(line_owner[worded], minlength=texts).astype(float)
    _, line_repeats, _ = _repeats(line[worded], line_owner[worded], texts)
    shares = [*(_share(count[:, k], solid) for k in (_UPPER, _DIGIT, _STOP, _SHOUT, _SIGN, _OTHER, _HIGH)),
              _share(count[:, _SPACE], chars), _share(kernel.count_in_texts(twice, offsets), solid),
              words_that(head == _UPPER), words_that((head == _SIGN) | (head == _OTHER)), words_that(tail == _STOP),
              words_that((tail == _SHOUT) | (tail == _SIGN) | (tail == _OTHER)), words_that(size == 1), words_that(size > 24),
              words_that(again), _share(distinct, n), _share(top, n), *runs, _share(line_repeats, lines), _share(lines, n)]
    sizes = [np.log1p(n), np.log1p(mean), np.log1p(spread), np.log1p(_share(n, lines)), (n < 1).astype(float), (n < 20).astype(float)]
    return np.stack([*shares, *map(np.sqrt, shares), *sizes], 1)


WIDTH = measures(np.frombuffer(b"a b", np.uint8), np.array([0, 3])).shape[1]


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, held_out, measures)`` of every row; measures: float32."""
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "_text", SLICE):
                found = measures(*kernel.utf8(part.column(2))).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r.tobytes() for r in found], pa.binary())],
                    ["_id", "held_out", "measures"])

    kind = rows.schema["_id"].dataType.simpleString()
    return written(rows.mapInArrow(tidy(run), f"_id {kind}, held_out boolean, measures binary"), "measures")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, WIDTH).astype(float)


def examples(rows: DataFrame, labels: DataFrame, label_id: str, label_col: str) -> DataFrame:
    """``(measures, good)`` of the labelled documents that are not held out, one an id."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(
        (F.avg(F.col(label_col).cast("double")) >= 0.5).alias("good"))
    one = rows.where("not held_out and _id is not null").groupBy("_id").agg(F.min("measures").alias("measures"))
    return written(one.join(marks, "_id").select("measures", "good"), "examples")


def _summed(rows: DataFrame, run, kind: str = "i int, n bigint") -> dict[int, float]:
    """Fixed-point sums by place; there are as many as the model has numbers."""
    return {i: n / UNIT for i, n in rows.mapInArrow(tidy(run), kind).groupBy("i").agg(F.sum("n")).collect()}


def _fixed(values: np.ndarray) -> pa.RecordBatch:
    whole = np.rint(values.ravel() * UNIT).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole)], ["i", "n"])


def _vector(sums: dict[int, float], size: int) -> np.ndarray:
    return np.array([sums.get(i, 0.0) for i in range(size)])


def scaling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each measure over the examples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * WIDTH + 1)
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield _fixed(total)

    sums = _vector(_summed(rows.select("measures"), run), 2 * WIDTH + 1)
    n = max(sums[-1], 1.0)
    mean = sums[:WIDTH] / n
    spread = np.sqrt(np.maximum(sums[WIDTH:-1] / n - mean * mean, 0))
    return mean, np.where(spread > 1e-6, spread, np.inf)


def pairs(rows: DataFrame, count: int, mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """``(differences)``: one row a bucket, scaled measures of a good document less those of another (float32)."""
    buckets = max(1, -(-count // BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def bucket() -> pa.RecordBatch:
            good = np.concatenate([h[1] for h in held])
            x = ((np.concatenate([h[0] for h in held]) - mean) / spread).astype("<f4")
            sides = x[good], x[~good]
            small, large = sorted(sides, key=len)
            if not len(small):
                return pa.RecordBatch.from_arrays([pa.array([b""], pa.binary())], ["differences"])
            partner = (np.arange(len(large))[:, None] + np.arange(min(PARTNERS, len(small)))) % len(small)
            found = large[:, None, :] - small[partner]
            return pa.RecordBatch.from_arrays(
                [pa.array([(found if large is sides[0] else -found).tobytes()], pa.binary())], ["differences"])

        for batch in batches:
            own = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else []
            for a, b in zip(cuts, cuts[1:]):
                if now is not None and own[a] != now:
                    yield bucket()
                    held.clear()
                now = own[a]
                part = batch.slice(int(a), int(b - a))
                held.append((_matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False).astype(bool)))
        if held:
            yield bucket()

    dealt = rows.select("measures", "good", F.pmod(F.xxhash64("measures", "good"), F.lit(buckets)).alias("bucket"))
    return written(dealt.repartition("bucket").sortWithinPartitions("bucket", "good", "measures").mapInArrow(
        tidy(run), "differences binary"), "preferences")


def fit(preferences: DataFrame) -> np.ndarray:
    """The weights of least logistic loss over all pairs, by Newton steps."""
    weights, places = np.zeros(WIDTH), WIDTH * WIDTH + WIDTH + 1
    for _ in range(STEPS):
        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            gradient, curve, n = np.zeros(WIDTH), np.zeros((WIDTH, WIDTH)), 0
            for batch in batches:
                for raw in batch.column(0):
                    x = np.frombuffer(raw.as_py(), "<f4").reshape(-1, WIDTH).astype(float)
                    miss = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
                    gradient += miss @ x
                    curve += (x * (miss * (1 - miss))[:, None]).T @ x
                    n += len(x)
            yield _fixed(np.concatenate([gradient, curve.ravel(), [n]]))

        sums = _vector(_summed(preferences, run), places)
        n = sums[-1]
        if not n:
            break
        curve = sums[WIDTH:-1].reshape(WIDTH, WIDTH) / n + RIDGE * np.eye(WIDTH)
        weights = weights + np.linalg.solve(curve, sums[:WIDTH] / n - RIDGE * weights)
    return weights


def threshold(rows: DataFrame, worth) -> float:
    """The quantile of the examples' worths that tells the marks apart best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(worth(_matrix(batch.column(0)))), batch.column(1)], ["worth", "good"])

    found = rows.mapInArrow(tidy(run), "worth double, good boolean")
    levels = [(i + 0.5) / QUANTILES for i in range(QUANTILES)]
    cuts = sorted(set(found.agg(F.percentile_approx("worth", levels, 10_000)).first()[0]))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("worth")))
    share = {True: np.zeros(len(cuts) + 1), False: np.zeros(len(cuts) + 1)}
    for good, i, n in found.groupBy("good", place.alias("i")).count().collect():  # two rows a quantile
        share[good][i] = n
    # rows below each cut, by mark, as shares of their mark
    low, high = (np.cumsum(share[mark])[:-1] / max(share[mark].sum(), 1) for mark in (False, True))
    best = np.flatnonzero(low - high >= (low - high).max() - 1e-12)
    return float(cuts[best[0]] + cuts[best[-1]]) / 2


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row."""
    rows = measured(docs, id_col, text_col)
    known = examples(rows, labels, label_id, label_col)
    marks = dict(known.groupBy("good").count().collect())
    if len(marks) == 2:
        mean, spread = scaling(known)
        weights = fit(pairs(known, sum(marks.values()), mean, spread))

        def worth(x: np.ndarray) -> np.ndarray:
            return ((x - mean) / spread * weights).sum(1)  # row by row, whatever the batch

        cut = threshold(known, worth) - np.log(CUT / (1 - CUT))
    else:
        def worth(x: np.ndarray) -> np.ndarray:
            return np.zeros(len(x))

        cut = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(worth(_matrix(batch.column(2))) - cut, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["_id", "held_out", "score"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"_id {kind}, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= CUT, 1).otherwise(0)).withColumnRenamed("_id", id_col)
