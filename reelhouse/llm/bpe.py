"""Byte-level BPE encoding and decoding with the tiktoken library (operator 6).

``encode`` gives every whole text its token ids, ``decode`` turns ids back into
raw bytes.  Both stream over the partitions of their input: no shuffle, and
memory is bounded by one Arrow batch and one text.

A long text is cut before it is encoded, at places where the splitting pattern
must end a match whatever stands around it: the change from a character that
is not white space to white space.  No match covers such a place and the
pattern only looks ahead, so the pieces' ids joined are the whole text's ids.

Cases: a null text counts as the empty text (no ids, empty bytes); a null in
any other column is kept; repeated rows are encoded each; an empty table gives
an empty result; of the input only the two named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse.llm.common import text_of, tidy
from reelhouse.llm.kernel import slices

#: Texts over this many code points are cut at safe places.
LONG = 1 << 16
#: Bytes of text encoded between two outputs of a task.
SLICE = 1 << 20
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, without special tokens; loaded once a worker."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    name = hashlib.sha256(f"{ranks_path}:{pattern}".encode()).hexdigest()[:16]
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Cut a text at the first safe place after every ``size`` code points."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = LONG) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, size) for i in enc.encode_ordinary(piece)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", size: int = LONG) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                ids = [encode_text(enc, t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", size: int = LONG) -> DataFrame:
    """``(id_col, ids array<int>, decoded binary)`` of every row: ``encode`` and ``decode`` in one Python worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                ids = [encode_text(enc, t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([enc.decode_bytes(i) for i in ids], pa.binary())], ["_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"_id {kind}, ids array<int>, decoded binary").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
           out_col: str = "decoded") -> DataFrame:
    """``encoded`` and its raw decoded bytes (null ids: empty bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                raw = [enc.decode_bytes(i or []) for i in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())],
                                                 [*part.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(tidy(run), f"{fields}, `{out_col}` binary")
