"""Hidden Markov language model (operator 1).

Tokens are the words of a text (A-Z lower-cased), then one end.  Every latent
state emits every word of the training texts by its own expected count, so what
is learnt grows with the corpus.

Training: all texts become blocks of about ``BLOCK`` bytes, a block's words as
numbers into its own vocabulary.  The first Baum-Welch rounds tie the words
that share a class (the low bits of their hash; the end has its own), so that
start, moves and the classes' emissions are small tables: every task runs the
scaled forward-backward recursion over its blocks and emits its expected counts
as fixed-point integers, which one grouping sums, so that the sum does not
depend on the order of tasks; the driver reads tables of fixed size.  The last
round unties them: a block sends each range of hashes its words with their
counts and their occurrences' shares by state, a range sums them over the
corpus, and the block gets its own words' sums back.  These tables are as long
as the vocabulary and stay on Spark.

A state emits the end by the tied rounds' probability, and a word by its
expected count there, smoothed by the words' corpus-wide shares with the weight
of one token for each distinct word, one unseen word included.

Scoring: a block meets its words' counts again, and the scaled forward
recursion gives each whole text's exact likelihood.

Long texts run in windows of ``WINDOW`` tokens side by side.  A window's
matrix product tells what it makes of any state before it, so the vectors that
enter and follow every window are those of the whole text, and so are the
likelihood and the expected counts.

Cases: a null text counts as the empty text (one token, its end); a null id
is kept and trains the model; repeated rows are texts like others; without
training texts all probabilities are uniform; an empty table gives an empty
result; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelhouse.llm import kernel
from reelhouse.llm.common import text_of, written
from reelhouse.llm.ranges import by_range, held_by_range, range_count

BLOCK = 4 << 20
#: Word classes of the tied rounds (a power of two), latent states, tied rounds.
CLASSES = 4096
STATES = 8
ROUNDS = 4
#: Tokens of a long text's windows; they change speed only.
WINDOW = 1024
#: Tokens of the forward-backward recursion at once.
GROUP = 1 << 17
#: Expected counts travel as integers of this unit.
UNIT = float(1 << 20)
#: A word's shares by state travel in these parts: from a block, and summed.
PART, WHOLE = 255, 65535
#: Weight of the corpus-wide class shares in a state's emissions.
PRIOR = 10.0


@dataclass(frozen=True)
class Model:
    """start[k], move[k, k], emit[symbol, k]; the last symbol is the end."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def held_out(id_col: str) -> Column:
    """True where crc32 of the id's text leaves 2 modulo 7 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def blocks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """``(block, ids, held, sizes, words, vocabulary)``: one row a block.

    ``words`` numbers the block's words in order (uint32, byte by byte) into
    ``vocabulary`` (hashes by range, uint64).
    """
    ranges = range_count(docs)
    rows = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in kernel.slices(batch, "_text", BLOCK):
                word, first = kernel.words(*kernel.utf8(part.column(2)), fold=True)
                vocabulary, at = np.unique(word, return_inverse=True)
                order, _ = by_range(vocabulary, ranges)
                place = np.empty(len(order), "<u4")
                place[order] = np.arange(len(order))
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([part.column(1).to_pylist()]), pa.array([np.diff(first).tolist()], pa.list_(pa.int64())),
                    # the high bytes, mostly 0, side by side
                    pa.array([place[at].view("u1").reshape(-1, 4).T.tobytes()], pa.binary()),
                    pa.array([vocabulary[order].astype("<u8").tobytes()], pa.binary()),
                ], ["block", "ids", "held", "sizes", "words", "vocabulary"])
                number += 1

    kind = rows.schema["_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"block bigint, ids array<{kind}>, held array<boolean>, sizes array<bigint>, "
                                        "words binary, vocabulary binary"), "lm-blocks", "zstd")


class Block:
    """A row of ``blocks`` as arrays."""

    def __init__(self, row: dict) -> None:
        self.number = row["block"]
        self.ids = row.get("ids")
        self.held = np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = np.frombuffer(row["words"], "u1").reshape(4, -1).T.copy().view("<u4").ravel()
        self.vocabulary = np.frombuffer(row.get("vocabulary") or b"", "<u8")

    def classes(self, n: int) -> np.ndarray:
        """Class of every token, the ends included, texts one after another."""
        of_word = (self.vocabulary & np.uint64(n - 1)).astype(np.int32)[self.words]
        return np.insert(of_word, np.cumsum(self.sizes), n)

    def symbols(self, types: int) -> np.ndarray:
        """Number in the vocabulary (of so many words) of every token, the ends the number after the last."""
        return np.insert(self.words.astype(np.int64), np.cumsum(self.sizes), types)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))


def _packed(kind: int, total: np.ndarray) -> pa.RecordBatch:
    """``(kind, i, j, n)`` of the non-zero cells of a table of integers."""
    i, j = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)),
                                       pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["kind", "i", "j", "n"])


def class_totals(rows: DataFrame, classes: int) -> np.ndarray:
    """Tokens of each class in the training texts; the end last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes + 1, np.int64)
        for b in _blocks(batches):
            total += np.bincount(b.classes(classes)[np.repeat(~b.held, b.sizes + 1)], minlength=classes + 1)
        yield _packed(0, total[:, None])

    tokens = np.zeros(classes + 1, np.int64)
    parts = rows.select("block", "held", "sizes", "words", "vocabulary").mapInArrow(run, "kind int, i int, j int, n bigint")
    for _, i, _, n in _summed(parts).collect():  # at most one row a class
        tokens[i] = n
    return tokens


def first_model(tokens: np.ndarray, states: int) -> Model:
    """Sticky states whose emissions are the class shares, unevenly perturbed."""
    shares = (tokens + 1.0) / (tokens + 1.0).sum()
    uneven = kernel.mix(np.arange(len(tokens) * states, dtype=np.uint64)) / float(1 << 64)
    emit = shares[:, None] * (0.5 + uneven.reshape(len(tokens), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), move, emit / emit.sum(0))


@dataclass(frozen=True)
class Windows:
    """Texts in windows: each one's first token, size, text and rank in its text; ``more``: another follows."""

    begins: np.ndarray
    sizes: np.ndarray
    text: np.ndarray
    rank: np.ndarray
    more: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Windows:
        n = -(-lengths // WINDOW)
        text = np.repeat(np.arange(len(lengths)), n)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        more = rank < n[text] - 1
        sizes = np.where(more, WINDOW, lengths[text] - rank * WINDOW)
        return Windows(np.cumsum(sizes) - sizes, sizes, text, rank, more)

    def groups(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some windows in groups of about ``GROUP`` tokens, like sizes together, longest first.

        Of each: the windows, their tokens by time then window, how many are
        active at each time, and the offsets of the times.
        """
        some = some[np.argsort(self.sizes[some], kind="stable")]
        split = np.flatnonzero(np.diff((np.cumsum(self.sizes[some]) - 1) // GROUP)) + 1
        for group in np.split(some, split) if len(some) else []:
            group = group[::-1]
            sizes = self.sizes[group]
            time = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token = (np.repeat(self.begins[group], sizes) + time)[np.argsort(time, kind="stable")]
            active = len(group) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
            yield group, token, active, np.concatenate([[0], np.cumsum(active)])


def boundaries(symbols: np.ndarray, windows: Windows, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(enter, ahead) of every window, both up to a factor.

    enter: the probabilities of the first token's state, by all tokens before.
    ahead: by the next window's first state, the probability of all tokens
    after this window; 0 where there are none.
    """
    states = len(model.start)
    enter, ahead = np.tile(model.start, (len(windows.sizes), 1)), np.zeros((len(windows.sizes), states))
    if not windows.more.any():
        return enter, ahead
    long = np.flatnonzero(windows.more | (windows.rank > 0))
    whole = np.zeros((len(windows.sizes), states, states))
    for group, token, active, offsets in windows.groups(long):
        emit = model.emit[symbols[token]]
        product = emit[:active[0], :, None] * np.eye(states)
        for t, n in enumerate(active[1:], 1):
            now = (product[:n] @ model.move) * emit[offsets[t]:offsets[t + 1], None, :]
            product[:n] = now / now.sum((1, 2))[:, None, None]
        whole[group] = product
    by_rank = long[np.argsort(windows.rank[long], kind="stable")]
    for at in np.split(by_rank, np.flatnonzero(np.diff(windows.rank[by_rank])) + 1)[1:]:
        enter[at] = np.einsum("ni,nij->nj", enter[at - 1], whole[at - 1]) @ model.move
        enter[at] /= enter[at].sum(1, keepdims=True)
    back = long[windows.more[long]]
    back = back[np.argsort(-windows.rank[back], kind="stable")]
    for at in np.split(back, np.flatnonzero(np.diff(windows.rank[back])) + 1):
        follows = np.where(windows.more[at + 1, None], ahead[at + 1] @ model.move.T, 1.0)
        ahead[at] = np.einsum("nij,nj->ni", whole[at + 1], follows)
        ahead[at] /= ahead[at].sum(1, keepdims=True)
    return enter, ahead


def log_likelihood(symbols: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Natural log likelihood of each sequence of symbols, by the scaled forward recursion."""
    windows = Windows.of(lengths)
    enter, _ = boundaries(symbols, windows, model)
    logs = np.zeros(len(windows.sizes))
    for group, token, active, offsets in windows.groups(np.arange(len(logs))):
        emit = model.emit[symbols[token]]
        part, state = np.zeros(len(group)), np.empty((0, 0))
        for t, n in enumerate(active):
            state = (enter[group] if t == 0 else state[:n] @ model.move) * emit[offsets[t]:offsets[t + 1]]
            scale = state.sum(1)
            state /= scale[:, None]
            part[:n] += np.log(scale)
        logs[group] = part
    return np.bincount(windows.text, logs, len(lengths))


def expected_counts(symbols: np.ndarray, lengths: np.ndarray, model: Model, names: np.ndarray | None = None,
                    count: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of some sequences.

    The last are by the tokens' ``names`` (numbers below ``count``), else by
    their symbols.
    """
    names, count = (symbols, len(model.emit)) if names is None else (names, count)
    states = len(model.start)
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((count, states))
    windows = Windows.of(lengths)
    enter, ahead = boundaries(symbols, windows, model)
    table, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    turned = np.ascontiguousarray(move.T)
    for group, token, active, offsets in windows.groups(np.arange(len(windows.sizes))):
        emit = table[symbols[token]]
        forward = np.empty_like(emit)
        scale = np.empty(len(token), np.float32)
        for t, n in enumerate(active):
            a, b = offsets[t], offsets[t + 1]
            if t == 0:
                forward[a:b] = enter[group] * emit[a:b]
            else:
                np.matmul(forward[offsets[t - 1]:offsets[t - 1] + n], move, out=forward[a:b])
                forward[a:b] *= emit[a:b]
            scale[a:b] = forward[a:b].sum(1)
            forward[a:b] /= scale[a:b, None]
        # what follows a token: emission times backward probability, scaled
        emit /= scale[:, None]
        back = np.ones_like(forward)
        more = np.flatnonzero(windows.more[group])
        if len(more):
            last = offsets[windows.sizes[group[more]] - 1] + more
            follows = ahead[group[more]]
            leave = follows @ model.move.T
            unit = (forward[last] * leave).sum(1, keepdims=True)
            back[last] = leave / unit
            moves += model.move * (forward[last].T.astype(np.float64) @ (follows / unit))
        for t in range(len(active) - 2, -1, -1):
            a, n = offsets[t], active[t + 1]
            emit[offsets[t + 1]:offsets[t + 1] + n] *= back[offsets[t + 1]:offsets[t + 1] + n]
            np.matmul(emit[offsets[t + 1]:offsets[t + 1] + n], turned, out=back[a:a + n])
        follows = np.arange(active[0], len(token))  # all tokens but the first of each window
        before = follows - np.repeat(active[:-1], active[1:])
        moves += model.move * (forward[before].T.astype(np.float64) @ emit[follows])
        forward *= back
        starts += forward[:active[0]][windows.rank[group] == 0].sum(0, dtype=np.float64)
        named = names[token]
        for k in range(states):
            emits[:, k] += np.bincount(named, forward[:, k], count)
    return starts, moves, emits


def _round(rows: DataFrame, model: Model) -> DataFrame:
    """Summed expected counts ``(kind, i, j, n)`` of one tied Baum-Welch round over all blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # fixed size: states x classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        states, classes = len(m.start), len(m.emit) - 1
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((classes + 1, states))]
        for b in _blocks(batches):
            lengths = b.sizes + 1
            every = b.classes(classes)[np.repeat(~b.held, lengths)]
            for total, part in zip(sums, expected_counts(every, lengths[~b.held], m)):
                total += part
        for kind, total in enumerate(sums):
            yield _packed(kind, np.rint(total.reshape(len(total), -1) * UNIT).astype(np.int64))

    return _summed(rows.select("block", "held", "sizes", "words", "vocabulary").mapInArrow(
        run, "kind int, i int, j int, n bigint"))


def train(rows: DataFrame, tokens: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Tied Baum-Welch rounds over all training texts."""
    model = first_model(tokens, states)
    shares = (tokens + 1.0) / (tokens + 1.0).sum()
    for _ in range(rounds if tokens.sum() else 0):
        start, move, emit = np.zeros((states, 1)), np.zeros((states, states)), np.zeros((len(tokens), states))
        for kind, i, j, n in _round(rows, model).collect():  # states x (classes + states + 2) rows at most
            (start, move, emit)[kind][i, j] = n / UNIT
        start = start[:, 0] + 1.0 / states
        move = move + np.eye(states) + 0.01
        emit = emit + PRIOR * shares[:, None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


_COUNTED = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("counts", pa.binary()), ("shares", pa.binary()),
                      ("n", pa.int64()), ("v", pa.int64()), ("by_state", pa.list_(pa.int64()))])


def word_counts(rows: DataFrame, model: Model) -> DataFrame:
    """The untied round: rows ``(block, range, counts, shares)`` and rows ``(n, v, by_state)``.

    counts: how often each of the block's words of that range occurs in all
    training texts (uint64); shares: by state, the part of these occurrences
    (uint16 of ``WHOLE``).  n and v: tokens and distinct words of one range in
    the training texts; by_state: their counts by state, in parts of ``WHOLE``.
    """
    ranges = range_count(rows)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # fixed size

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _blocks(batches):
            types, trained = len(b.vocabulary), np.repeat(~b.held, b.sizes + 1)
            _, _, expected = expected_counts(b.classes(len(m.emit) - 1)[trained], b.sizes[~b.held] + 1, m,
                                             b.symbols(types)[trained], types + 1)
            n = np.bincount(b.words[np.repeat(~b.held, b.sizes)], minlength=types)
            share = np.clip(np.rint(expected[:types] * (PART / np.maximum(n, 1))[:, None]), 0, PART).astype("u1")
            _, bounds = by_range(b.vocabulary, ranges)  # the vocabulary is in this order
            word, n = b.vocabulary, n.astype("<u4")
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                yield pa.RecordBatch.from_arrays([
                    pa.array(some), pa.array(np.full(len(some), b.number)),
                    *(pa.array([x[bounds[r]:bounds[r + 1]].tobytes() for r in some], pa.binary()) for x in (word, n, share))],
                    ["range", "block", "words", "n", "shares"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = len(shared.value.start)
        for held in held_by_range(batches):
            words = [np.frombuffer(r["words"], "<u8") for r in held]
            word, at = np.unique(np.concatenate(words), return_inverse=True)
            n = np.concatenate([np.frombuffer(r["n"], "<u4") for r in held]).astype(np.int64)
            share = np.concatenate([np.frombuffer(r["shares"], "u1") for r in held]).reshape(-1, states)
            total, by_state = np.zeros(len(word), np.int64), np.zeros((len(word), states), np.int64)
            np.add.at(total, at, n)
            for k in range(states):
                np.add.at(by_state[:, k], at, n * share[:, k])
            by_state = np.rint(by_state * (WHOLE / np.maximum(by_state.sum(1), 1))[:, None]).astype("<u2")
            ends = np.cumsum([len(w) for w in words])[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["block"] for r in held], pa.int64()), pa.array([r["range"] for r in held], pa.int64()),
                pa.array([p.astype("<u8").tobytes() for p in np.split(total[at], ends)], pa.binary()),
                pa.array([p.tobytes() for p in np.split(by_state[at], ends)], pa.binary()),
                pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.list_(pa.int64()))],
                schema=_COUNTED)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                pa.array([int(total.sum())]), pa.array([int((total > 0).sum())]),
                pa.array([(total @ by_state.astype(np.int64)).tolist()], pa.list_(pa.int64()))], schema=_COUNTED)

    packed = rows.select("block", "held", "sizes", "words", "vocabulary").mapInArrow(
        spread, "range bigint, block bigint, words binary, n binary, shares binary")
    return written(packed.repartition("range").sortWithinPartitions("range").mapInArrow(
        count, "block bigint, range bigint, counts binary, shares binary, n bigint, v bigint, by_state array<bigint>"),
        "lm-counts", "zstd")


@dataclass(frozen=True)
class Words:
    """What all blocks share of the untied model: tokens, distinct words, by state their expected count; ends."""

    model: Model
    tokens: int
    distinct: int
    by_state: np.ndarray
    ends: int

    def emissions(self, known: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """emit[word, k] of words with these counts and shares by state; the end last."""
        end, weight = self.model.emit[-1], max(self.distinct, 1)
        unigram = (known + 1.0) / (self.tokens + self.distinct + 1.0)
        own = known[:, None] * (shares / WHOLE) + weight * unigram[:, None]
        return np.concatenate([own * ((1.0 - end) / (self.by_state + weight)), end[None]])


def untied(counts: DataFrame, model: Model, ends: int) -> Words:
    """The untied model's totals: one row."""
    found = counts.agg(F.sum("n"), F.sum("v"), *[F.sum(F.col("by_state")[k]) for k in range(len(model.start))]).first()
    tokens, distinct, *by_state = (int(x or 0) for x in found)
    return Words(model, tokens, distinct, np.array(by_state) / WHOLE, ends)


def score(rows: DataFrame, counts: DataFrame, words: Words, id_col: str) -> DataFrame:
    """Base and model scores of every text of the blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(words)  # fixed size
    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def scored(b: Block, ids: pa.Array, raw: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        w = shared.value
        total, types, states = w.tokens + w.ends, w.distinct + (w.ends > 0), len(w.model.start)
        # the ranges' words one after another are the block's vocabulary
        known = np.frombuffer(b"".join(counted for counted, _ in raw), "<u8").astype(np.int64)
        shares = np.frombuffer(b"".join(by_state for _, by_state in raw), "<u2").reshape(-1, states)
        lengths, symbols = b.sizes + 1, b.symbols(len(known))
        count = np.append(known, w.ends)[symbols]
        ends = np.cumsum(lengths)

        def per_text(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[ends] - sums[ends - lengths]

        model = Model(w.model.start, w.model.move, w.emissions(known, shares))
        return pa.RecordBatch.from_arrays([
            ids, pa.array(b.held), pa.array(lengths), pa.array(per_text((count > 0).astype(np.int64))),
            pa.array(np.full(len(lengths), total)),
            pa.array(per_text(np.log10(count + 1.0)) - lengths * np.log10(total + types + 1.0)),
            pa.array(log_likelihood(symbols, lengths, model) / np.log(10.0))],
            ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, raw = None, None, []
        for batch in batches:
            names = ("range", "ids", "counts", "shares")
            at, column, counted, by_state = (batch.schema.get_field_index(n) for n in names)
            for i in range(batch.num_rows):  # a block's own row, then its counts by range
                one = batch.slice(i, 1)
                if one.column(at)[0].as_py() < 0:
                    if block is not None:
                        yield scored(block, ids, raw)
                    block, ids, raw = Block(one.to_pylist()[0]), one.column(column).flatten(), []
                else:
                    raw.append((one.column(counted)[0].as_py(), one.column(by_state)[0].as_py()))
        if block is not None:
            yield scored(block, ids, raw)

    none = F.lit(None).cast("binary")
    both = rows.drop("vocabulary").withColumns({"range": F.lit(-1).cast("long"), "counts": none, "shares": none}).unionByName(
        counts.where("block is not null").select("block", "range", "counts", "shares"), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "range").mapInArrow(
        run, f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double").withColumnRenamed("_id", id_col)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None,
                          states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the texts that are not held out and score all."""
    rows = blocks(docs, id_col, text_col, held_out(id_col) if held is None else held)
    tokens = class_totals(rows, classes)
    model = train(rows, tokens, states, rounds)
    counts = word_counts(rows, model)
    return score(rows, counts, untied(counts, model, int(tokens[-1])), id_col)
