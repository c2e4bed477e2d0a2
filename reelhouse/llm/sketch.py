"""Threshold-scaled document fingerprints (operator 10).

A fingerprint keeps every 5-word shingle hash below a fixed share of the hash
range, so its size follows the text's and two fingerprints of one scale can be
merged, compared or nested whatever their texts' lengths.  The smallest hash
is kept as well, so that a text with any word has a fingerprint; the smallest
of a union is the smaller one, so merging stays exact.

``in_order`` puts every row before the following one without sorting
in one task: rows go to ranges of the key, and the first row of each
range is copied to the range before it.

Cases: a null text counts as the empty text, whose fingerprint is empty; two
empty fingerprints are alike (1.0), an empty and another are not (0.0); null
keys come last, equal keys in order of their texts; repeated rows are kept;
the row after the last is the first, a single row follows itself; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse.llm import kernel
from reelhouse.llm.common import text_of

#: One of so many hashes is kept.
SCALE = 8
#: Words of a shingle.
WORDS = 5
SLICE = 2 << 20


def sketches(texts: pa.Array, scale: int = SCALE) -> list[np.ndarray]:
    """The kept hashes of each text, sorted."""
    data, offsets = kernel.utf8(texts)
    word, first = kernel.words(data, offsets)
    roll, at = kernel.ngrams(word, first, WORDS)
    low = roll < np.uint64(kernel.MASK // scale)
    kept, bounds = roll[low], np.searchsorted(at[low], first, side="left")
    whole = np.searchsorted(at, first, side="left")
    out = []
    for i in range(len(first) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            out.append(np.unique(kept[a:b]))
        elif whole[i + 1] > whole[i]:  # nothing below the share: the smallest alone
            out.append(roll[whole[i]:whole[i + 1]].min(keepdims=True))
        else:  # fewer words than a shingle: the whole sequence, or nothing
            out.append(next(kernel.shingle_sets(word[first[i]:first[i + 1]], np.array([0, first[i + 1] - first[i]]), WORDS)))
    return out


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The fingerprint of both texts' shingles together."""
    both = np.union1d(a, b)
    return both[: max(1, int(np.searchsorted(both, np.uint64(kernel.MASK // scale))))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has (an empty a is contained)."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """``(id_col, fingerprint)`` of every row; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, "_text", SLICE):
                marks = [to_text(s) for s in sketches(part.column(1), scale)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks, pa.string())], ["_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, fingerprint string").withColumnRenamed("_id", id_col)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(_range, _copy, _id, _text)``, sorted inside the tasks.

    The rows of a range are in one task, in order; then come (``_copy``) the
    rows with the first key of the range after it.
    """
    spark = docs.sparkSession
    # two ranges a task even out what hashing the range numbers leaves uneven
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    keys = rows.select("_id").where(F.col("_id").isNotNull())
    # one row a range: bounded by their number
    heads = sorted(r[0] for r in keys.repartitionByRange(ranges, "_id").groupBy(F.spark_partition_id())
                   .agg(F.min("_id").alias("head")).select("head").distinct().collect())
    last = max(len(heads) - 1, 0)
    is_head = set(heads) or {None}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            own = [last if i is None else max(bisect_right(heads, i) - 1, 0) for i in ids]
            copies = [k for k, i in enumerate(ids) if i in is_head]
            before = [(own[k] - 1 if own[k] else last) if heads else 0 for k in copies]
            for rows_, at, copy in ((batch, own, False), (batch.take(pa.array(copies, pa.int64())), before, True)):
                if rows_.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int32()), pa.array([copy] * rows_.num_rows), *rows_.columns],
                        ["_range", "_copy", "_id", "_text"])

    kind = rows.schema["_id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"_range int, _copy boolean, _id {kind}, _text string")
    return placed.repartition(ranges // 2, "_range").sortWithinPartitions(
        "_range", "_copy", F.col("_id").asc_nulls_last(), "_text")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Runs of rows in order, and the places of own rows, each followed by the next text."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        for part in kernel.slices(batch, "_text", SLICE):
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            n = part.num_rows - 1  # the last row waits for what follows it
            if n:
                copy = part.column(1).to_pylist()[:n]
                own = [k for k in range(n) if not copy[k]]
                if own:
                    yield part, own
            held = part.slice(n)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edit with the next text, their likeness and containment.

    Containment is the share of the text's own shingles that the other has.

    The edit replaces a text's last half by as much of the next one's start.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _followed(batches):
            run_texts, run_marks = part.column(3).to_pylist(), sketches(part.column(3), scale)
            texts = [run_texts[k] for k in own]
            edits = [t[:len(t) - len(t) // 2] + run_texts[k + 1][:len(t) // 2] for t, k in zip(texts, own)]
            a, c = [run_marks[k] for k in own], [run_marks[k + 1] for k in own]
            b = sketches(pa.array(edits, pa.large_string()), scale)
            yield pa.RecordBatch.from_arrays([
                part.column(2).take(pa.array(own, pa.int64())), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
                pa.array([to_text(x) for x in a]), pa.array([to_text(x) for x in b]),
                *(pa.array([of(x, y) for x, y in zip(a, other)], pa.float64())
                  for of in (likeness, containment) for other in (b, c)),
            ], ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                "contain_edited", "contain_next"])

    rows = in_order(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                           "edited_fingerprint string, near_edited double, near_next double, "
                           "contain_edited double, contain_next double"
                           ).withColumnRenamed("_id", id_col)
