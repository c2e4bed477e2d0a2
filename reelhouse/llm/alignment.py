"""Cross-tokenizer alignment by an identity-map fast path (operator 11).

Every text is encoded by a byte-level BPE tokenizer (A) and by a piece
tokenizer with byte fallback (B).  Where a token of A and a token of B end at
the same byte, both sequences are cut; what lies between two cuts is a group,
and the two tokens that end there are linked.

A group of one token on both sides covers the same bytes twice.  An array over
A's ids, made beforehand from the two vocabularies, gives the B id of the same
bytes, so such groups are counted in vectors as long as A's vocabulary; only
the links of other groups are counted by a shuffle of id pairs.  (A pair of the
map never ends an irregular group: equal bytes that end together also start
together, and the cut before them makes the group regular.)

Texts are handled in blocks.  A block sends each of its distinct irregular
pairs once, with a count, so a pair that stands in every document is as many
rows as there are blocks.  What tasks share besides are vectors over the
vocabularies: A's identity counts and B's highest counts.

Memory: the pass that encodes also counts, so links are written with their text
and read once.  A row holds the links of one text, never those of a block, as
the JVM keeps batches of rows outside its heap and long ones in regions of their
own.  A task remembers parts up to a number and a size, and the tasks that come
after the encoding drop what a worker knows.

Cases: a null or empty text, and one whose tokens do not give back its bytes,
has no tokens (zeros, an empty ``groups_sha256``); null ids and repeated rows
are kept, one result row each; an empty table gives an empty result; only the
two named columns are read.  Texts are cut at spaces that no token of either
side goes over, and a part that a task has met is not encoded again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelhouse.llm import kernel
from reelhouse.llm.common import text_of, tidy, written

#: Bytes of text in a block (one text at least).
BLOCK = 4 << 20
#: Bytes of text whose groups are put together at once (one text at least).
SLICE = 1 << 20
#: Links whose counts are looked up at once (one text's at least).
LINKS = 1 << 18
#: Pairs in a row.
PAIRS = 1 << 14
#: Characters encoded by one library call (one part at least).
CALL = 1 << 18
#: Sequences put together at once.
RUN = 1 << 16
#: Parts a worker remembers between slices, and the bytes of these and their groups (beyond either it starts anew).
REMEMBERED = 300_000
REMEMBERED_BYTES = 32 << 20
#: A space between a character that is no white space in any table and another character.
_BETWEEN = re.compile("(?<=[!-~\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff\u3041-\u30ff\u4e00-\u9fff]) (?=.)", re.S)


class Ragged:
    """Sequences of unlike length by id, held in one buffer."""

    def __init__(self, data: np.ndarray, size: np.ndarray) -> None:
        self.data, self.size = data, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of_bytes(cls, items: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(items), np.uint8), np.array([len(i) for i in items], np.int64))

    def more(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.data, other.data]), np.concatenate([self.size, other.size]))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """What all ids hold, one after another."""
        bounds = _bounds(self.size[ids])
        out = np.empty(bounds[-1], self.data.dtype)
        for at in range(0, len(ids), RUN):  # so that the places take little memory
            some, own = ids[at:at + RUN], bounds[at:at + RUN + 1]
            shift = np.repeat(self.start[some] - own[:-1], np.diff(own))
            out[own[0]:own[-1]] = self.data[shift + np.arange(own[0], own[-1])]
        return out


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens and the identity map."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        char = _byte_of_char()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        # a special token's name is never in a text's tokens; its bytes do not matter
        bytes_a = [bytes(char[c] for c in n) if all(c in char for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(pieces)]
        if not all(bytes_a) or not all(bytes_b):
            raise ValueError("a token without bytes")
        usual = {}
        for i, raw in enumerate(bytes_b):  # a piece before a byte of the same bytes
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (raw not in usual or self.b.is_byte(usual[raw])):
                usual[raw] = i
        self.same = np.array([usual.get(raw, -1) for raw in bytes_a], np.int64)
        self.raw_a, self.raw_b = Ragged.of_bytes(bytes_a), Ragged.of_bytes(bytes_b)
        # decimal ids, each with room for the sign that follows it
        self.text_a = Ragged.of_bytes([b"%d," % i for i in range(len(bytes_a))])
        self.text_b = Ragged.of_bytes([b"%d," % i for i in range(len(bytes_b))])
        #: True if no piece of B goes over the start of a space.
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)

    def parts(self, text: str) -> list[str]:
        """The text without the spaces that no token of either side goes over; encoding adds one before every part."""
        return _BETWEEN.split(text) if self.cuttable else [text]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their number in each part, ids of B, their number)."""
        ids: tuple[list, list] = ([], [])
        counts: tuple[list, list] = ([], [])
        at = 0
        while at < len(parts):
            to, size = at + 1, len(parts[at])
            while to < len(parts) and size + len(parts[to]) <= CALL:
                size += len(parts[to])
                to += 1
            some = parts[at:to]
            both = ([e.ids for e in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)],
                    self.b.encode(some, num_threads=1))
            for side, found in enumerate(both):
                ids[side].append(np.fromiter(chain.from_iterable(found), np.int32))
                counts[side].extend(map(len, found))
            at = to
        a, b = (np.concatenate([np.empty(0, np.int32), *side]) for side in ids)
        return a, np.array(counts[0], np.int64), b, np.array(counts[1], np.int64)


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


@lru_cache(maxsize=1)
def known(path_a: str, path_b: str) -> Known:
    """One a worker, so that its next task remembers too."""
    return Known(pair(path_a, path_b))


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    return np.diff(_bounds(values)[_bounds(sizes)])


class Parts:
    """The groups of some parts, encoded one by one.

    ``whole``: True if the tokens give back the part.  ``n_a``, ``n_b``: tokens.
    ``same``: A ids of the identity groups, ``odd``: ``a * |B| + b`` of the
    other groups' links, ``text``: the groups as ``a1,a2|b1;`` each.
    """

    def __init__(self, p: Pair, parts: list[str]) -> None:
        a, n_a, b, n_b = p.encode(parts)
        self.whole = _gives_back(p.raw_a, a, n_a, parts) & _gives_back(p.raw_b, b, n_b, parts)
        self.whole &= np.array([t != "" for t in parts], bool)
        a, b = a[np.repeat(self.whole, n_a)], b[np.repeat(self.whole, n_b)]
        self.n_a, self.n_b = np.where(self.whole, n_a, 0), np.where(self.whole, n_b, 0)
        # both sides now cover the same bytes, so their ends are comparable over all parts
        ends_a, ends_b = np.cumsum(p.raw_a.size[a]), np.cumsum(p.raw_b.size[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        part_end = np.concatenate([[0], ends_a])[np.cumsum(self.n_a)]
        n_groups = np.diff(np.searchsorted(cuts, np.concatenate([[0], part_end]), side="right"))
        link_a, link_b = a[last_a].astype(np.int64), b[last_b].astype(np.int64)
        one = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        one &= p.same[link_a] == link_b
        n_same = _per_text(one.astype(np.int64), n_groups)
        self.same = Ragged(link_a[one].astype(np.int32), n_same)
        self.odd = Ragged((link_a * len(p.raw_b.size) + link_b)[~one], n_groups - n_same)
        self.text = self._text(p, a, b, last_a, last_b)

    def _text(self, p: Pair, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> Ragged:
        before_a = np.repeat(np.concatenate([[0], last_b + 1])[:len(last_a)], np.diff(last_a, prepend=-1))
        after_b = np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        place_a, place_b = np.arange(len(a)) + before_a, np.arange(len(b)) + after_b
        sizes = np.empty(len(a) + len(b), np.int64)
        sizes[place_a], sizes[place_b] = p.text_a.size[a], p.text_b.size[b]
        starts = _bounds(sizes)
        out = np.empty(starts[-1], np.uint8)
        for table, ids, place in ((p.text_a, a, place_a), (p.text_b, b, place_b)):
            for at in range(0, len(ids), RUN):
                some = ids[at:at + RUN]
                size = table.size[some]
                shift = np.repeat(starts[place[at:at + RUN]] - (np.cumsum(size) - size), size)
                out[shift + np.arange(len(shift))] = table.joined(some)
        out[starts[place_a[last_a] + 1] - 1] = ord("|")
        out[starts[place_b[last_b] + 1] - 1] = ord(";")
        return Ragged(out, np.diff(starts[_bounds(self.n_a + self.n_b)]))


class Known:
    """The parts that a task has met, each encoded once."""

    def __init__(self, p: Pair) -> None:
        self.pair = p
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.held = Parts(self.pair, [])
        self.chars = 0

    def full(self) -> bool:
        held = self.chars + sum(x.data.nbytes for x in (self.held.same, self.held.odd, self.held.text))
        return len(self.place) > REMEMBERED or held > REMEMBERED_BYTES

    def look_up(self, parts: list[str]) -> np.ndarray:
        """The places of the parts in ``held``."""
        if self.full():
            self.clear()
        before, place = len(self.place), self.place
        out = np.array([place.setdefault(p, len(place)) for p in parts], np.int64)
        unmet = list(islice(place, before, None))
        self.chars += sum(map(len, unmet))
        new = Parts(self.pair, unmet)
        for name in ("whole", "n_a", "n_b"):
            setattr(self.held, name, np.concatenate([getattr(self.held, name), getattr(new, name)]))
        for name in ("same", "odd", "text"):
            setattr(self.held, name, getattr(self.held, name).more(getattr(new, name)))
        return out


class Aligned:
    """The groups of some texts, put together from those of their parts.

    Tokens of both sides end where a part ends, so no group goes over it.
    """

    def __init__(self, known: Known, texts: list[str]) -> None:
        parts = [known.pair.parts(t) for t in texts]
        sizes = np.array([len(x) for x in parts], np.int64)
        at, held = known.look_up([x for one in parts for x in one]), known.held
        whole = _per_text((~held.whole[at]).astype(np.int64), sizes) == 0
        at, sizes = at[np.repeat(whole, sizes)], np.where(whole, sizes, 0)
        self.n_a, self.n_b = _per_text(held.n_a[at], sizes), _per_text(held.n_b[at], sizes)
        self.n_same, self.n_odd = _per_text(held.same.size[at], sizes), _per_text(held.odd.size[at], sizes)
        self.n_groups = self.n_same + self.n_odd
        self.same, self.odd = held.same.joined(at), held.odd.joined(at)
        text = held.text.joined(at)
        bounds = _bounds(_per_text(held.text.size[at], sizes)).tolist()
        # the sign after a text's last group is not part of it
        self.digests = [hashlib.sha256(text[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(bounds, bounds[1:])]


def _gives_back(raw: Ragged, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> np.ndarray:
    """True for each text whose tokens' bytes are a space and the text."""
    joined = raw.joined(ids).tobytes()
    ends = _bounds(raw.size[ids])[_bounds(counts)].tolist()
    return np.array([joined[a:b] == b" " + t.encode() for a, b, t in zip(ends, ends[1:], texts)], bool)


def _forget() -> None:
    """Drops what this worker knows of the tokenizers."""
    known.cache_clear()
    pair.cache_clear()


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of all arrays and the sum of each one's counts."""
    code, which = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_inverse=True)
    n = np.zeros(len(code), np.int64)
    np.add.at(n, which, np.concatenate([np.empty(0, np.int64), *counts]))
    return code, n


def _cells(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary cell a text, which holds its values."""
    ends = _bounds(sizes) * values.itemsize
    cells = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(values)])
    return cells.cast(pa.binary())


def _values(cells: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all cells, their number in each) of binary cells, none of them null."""
    cells = cells.cast(pa.large_binary())
    ends = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset:cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return data.view(kind), np.diff(ends) // kind.itemsize


def _structs(names: tuple[str, str], first: np.ndarray, second: np.ndarray) -> pa.Array:
    """One row that lists the pairs of both arrays."""
    pairs = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], list(names))
    return pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), pairs)


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``limit`` (one row at least)."""
    bounds, at = _bounds(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def link_type(p: Pair) -> np.dtype:
    """Of A's ids in a ``same`` cell."""
    return np.dtype("<u2" if len(p.same) <= 1 << 16 else "<i4")


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds, each with the other kinds' columns null.

    One a text: its id, measures and links (``same``: A ids, ``odd``: int64
    codes).  Some a block: its distinct irregular links (``pairs``) and how
    often it has each.  Some a task: how often it has each identity group
    (``counts``).
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    columns = ["block", "_id", "n_a", "n_b", "digest", "same", "odd", "pairs", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known(path_a, path_b)
        links, size = link_type(own.pair), len(own.pair.same)
        number = TaskContext.get().partitionId() << 32
        total, id_type = np.zeros(size, np.int64), None
        listed = {"pairs": ("code", "n"), "counts": ("a", "n")}
        kinds = {k: pa.list_(pa.struct([(x, pa.int64()) for x in v])) for k, v in listed.items()}

        def made(n: int, **given: pa.Array) -> pa.RecordBatch:
            types = {"block": pa.int64(), "_id": id_type, "n_a": pa.int64(), "n_b": pa.int64(), "digest": pa.string(),
                     "same": pa.binary(), "odd": pa.binary()} | kinds
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, types[c])) for c in columns], columns)

        for batch in batches:
            id_type = batch.column(0).type
            for block in kernel.slices(batch, "_text", BLOCK):
                codes, counts = [], []
                for part in kernel.slices(block, "_text", SLICE):
                    got = Aligned(own, part.column(1).to_pylist())
                    total += np.bincount(got.same, minlength=size)
                    for x, y in zip(np.unique(got.odd, return_counts=True), (codes, counts)):
                        y.append(x)
                    yield made(part.num_rows, block=pa.array(np.full(part.num_rows, number)), _id=part.column(0),
                               n_a=pa.array(got.n_a), n_b=pa.array(got.n_b), digest=pa.array(got.digests, pa.string()),
                               same=_cells(got.same.astype(links), got.n_same), odd=_cells(got.odd.astype("<i8"), got.n_odd))
                code, n = _added(codes, counts)
                for at in range(0, len(code), PAIRS):
                    yield made(1, block=pa.array([number]),
                               pairs=_structs(listed["pairs"], code[at:at + PAIRS], n[at:at + PAIRS]))
                number += 1
        some = np.flatnonzero(total)
        for at in range(0, len(some), PAIRS):
            a = some[at:at + PAIRS]
            yield made(1, counts=_structs(listed["counts"], a, total[a]))

    return written(rows.mapInArrow(tidy(run), (
        f"block bigint, _id {kind}, n_a bigint, n_b bigint, digest string, same binary, odd binary, "
        "pairs array<struct<code: bigint, n: bigint>>, counts array<struct<a: bigint, n: bigint>>")), "alignment", "zstd")


def identity_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each A id is an identity group, over all tasks: a vector of A's vocabulary."""
    out = np.zeros(size, np.int64)
    sums = rows.where("counts is not null").select(F.inline("counts")).groupBy("a").agg(F.sum("n"))
    for a, n in sums.collect():  # at most one row an id of A
        out[a] = n
    return out


def irregular_pairs(rows: DataFrame) -> DataFrame:
    """``(block, code, n)``: the distinct irregular links of every block and how often it has each."""
    return rows.where("pairs is not null").select("block", F.inline("pairs"))


def best_counts(identity: np.ndarray, same: np.ndarray, counts: DataFrame, size: int) -> np.ndarray:
    """The highest count of any link of each B id: a vector of B's vocabulary."""
    best = np.zeros(size, np.int64)
    held = same >= 0
    np.maximum.at(best, same[held], identity[held])
    for b, n in counts.groupBy((F.col("code") % size).alias("b")).agg(F.max("total")).collect():  # one row an id of B
        best[b] = max(best[b], n)
    return best


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    A link's count is how many links of the whole table join the same two ids;
    it is best if no other link of its B id has a higher count.  One link ends
    every group.
    """
    spark = docs.sparkSession
    rows = blocks(docs, path_a, path_b, id_col, text_col)
    p = pair(path_a, path_b)
    size_b, links = len(p.raw_b.size), link_type(p)
    identity = identity_counts(rows, len(p.same))
    pairs = irregular_pairs(rows)
    counts = written(pairs.groupBy("code").agg(F.sum("n").alias("total")), "alignment-counts", "zstd")
    best = best_counts(identity, p.same, counts, size_b)
    held = p.same >= 0
    top = np.zeros(len(p.same), bool)
    top[held] = identity[held] == best[p.same[held]]
    shared = spark.sparkContext.broadcast((identity, top, best))  # as long as the vocabularies
    kind = rows.schema["_id"].dataType.simpleString()
    sums = ["n_groups", "n_best", "count_sum"]

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        same_n, same_top, _ = shared.value
        for batch in batches:
            same, n_same = _values(batch.column(5), links)
            bounds = _bounds(n_same)
            for at, to in _runs(n_same, LINKS):
                own, sizes = same[bounds[at]:bounds[to]], n_same[at:to]
                some = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:5], pa.array(sizes), pa.array(_per_text(same_top[own].astype(np.int64), sizes)),
                     pa.array(_per_text(same_n[own], sizes)), some.column(6)],
                    ["block", "_id", "n_a", "n_b", "digest", *sums, "odd"])

    # the identity groups are summed up where they lie; only what other links need is dealt out by block
    texts = rows.where("n_a is not null").select("block", "_id", "n_a", "n_b", "digest", "same", "odd").mapInArrow(
        tidy(regular), f"block bigint, _id {kind}, n_a bigint, n_b bigint, digest string, "
                       f"{', '.join(f'{c} bigint' for c in sums)}, odd binary")
    # both sides are bare shuffles, so that Spark can split a frequent pair's rows
    answers = pairs.select("block", "code").join(counts.hint("merge"), "code").select("block", "code", "total")

    def finished(some: pa.RecordBatch, code: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        best_n = shared.value[2]
        odd, n_odd = _values(some.column(8), np.dtype("<i8"))
        bounds = _bounds(n_odd)
        for at, to in _runs(n_odd, LINKS):
            own, sizes, part = odd[bounds[at]:bounds[to]], n_odd[at:to], some.slice(at, to - at)
            n_link = total[np.searchsorted(code, own)] if len(own) else np.empty(0, np.int64)
            n_same, n_best, count_sum = (part.column(i).to_numpy() for i in (5, 6, 7))
            groups = pa.array(n_same + sizes)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:4], groups, groups,
                 pa.array(n_best + _per_text((n_link == best_n[own % size_b]).astype(np.int64), sizes)),
                 pa.array(count_sum + _per_text(n_link, sizes)), part.column(4)],
                ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        now, found = None, []
        for batch in batches:  # of every block its answers, then its texts
            block = batch.column(0).to_numpy()
            own = batch.column(batch.schema.get_field_index("own")).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(block) != 0) | (own[1:] != own[:-1])) + 1
            for at, to in pairwise([0, *turns.tolist(), batch.num_rows]):
                if at == to:
                    continue
                if block[at] != now:
                    now, found = block[at], []
                some = batch.slice(at, to - at)
                if not own[at]:
                    found.append([some.column(some.schema.get_field_index(c)).to_numpy() for c in ("code", "total")])
                    continue
                code, total = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
                order = np.argsort(code)
                yield from finished(some, code[order], total[order])

    both = texts.withColumn("own", F.lit(True)).unionByName(
        answers.withColumn("own", F.lit(False)), allowMissingColumns=True)
    longs = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return both.repartition("block").sortWithinPartitions("block", "own").mapInArrow(
        tidy(run), f"_id {kind}, {longs}, groups_sha256 string").withColumnRenamed("_id", id_col)
