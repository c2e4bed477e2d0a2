"""Exact n-gram Jaccard join by pivots in the Jaccard metric (operator 8).

Texts are sets of 5-word shingles; 1 - Jaccard similarity is a metric.  Two
sets link at a distance of at most 0.2.  Equal sets are one point.

1. A point's *core* is its set without the shingles no other point has.  Its
   distance to the core is the lone share, and no other point is closer than
   that, so points whose lone share is over 0.2 are settled without partners.
   What is common is counted by ranges of the hash: a block of texts sends each
   range one packed row, and gets the counts (or frequencies) back as one.
2. Regions of one-shingle pivots: the cells of the pivots nearest to a point
   are its own shingles, rarest first.  A linked pair shares one of the first
   ``floor(0.2 n) + 1`` cells of either point, so a point is copied to these
   only, without the lone ones.
3. In every region the most central point (smallest lone share) is its pivot.
   Points within 0.2 of it link to it.  Two points can only link if their
   distances to the region's pivot differ by at most 0.2, and if their cores,
   counted in fixed parts of the hash's range, have enough in common.  The
   points that some partner may remain for, of all regions with the same pivot
   together, form the next, smaller region, which takes a new pivot, and so on;
   regions of at most ``LEAF`` points, and what is left after ``ROUNDS``
   rounds, compare the remaining pairs by blocks.  All pairs found are verified
   on their whole sets.

For components, pairs that are already connected need no comparison
(``all_links=False``), which is what keeps large groups of near copies linear.

Cases: null or empty texts are empty sets, linked with nothing; a text with
fewer words is one shingle; null ids are kept (their component is the smallest
other id, or null); rows with equal ids are separate documents; an empty table
gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reelhouse.llm import kernel
from reelhouse.llm.common import text_of, tidy, written
from reelhouse.llm.components import components
from reelhouse.llm.ranges import by_range, held_by_range, range_count

#: Words of a shingle, and the least similarity of a link, in percent.
WORDS = 5
PERCENT = 80
#: Bytes of text, or of hashes, of a block.
BLOCK = 2 << 20
#: Points of a region that is compared pair by pair.
LEAF = 128
#: Rounds of pivots.
ROUNDS = 3
#: Parts of the hash's range in which common shingles are counted.
SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return list(kernel.shingle_sets(*kernel.words(*kernel.utf8(texts), fold=True), WORDS))


# --- 1. what is common -----------------------------------------------------

def _packed(number: int, sets: list[np.ndarray], ranges: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """``(range, block, points, keys, point of each key)`` for the ranges that the block's sets touch."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)  # kernel.ROWS points at most
    order, bounds = by_range(flat, ranges)
    low, owner = flat[order].astype(np.uint32), owner[order]
    for r in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[r], bounds[r + 1]
        yield int(r), number, len(sets), low[a:b].tobytes(), owner[a:b].tobytes()


_PACKED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("points", pa.int64()), ("keys", pa.binary()),
                     ("owner", pa.binary())])


def _frequencies(rows: list[dict]) -> list[np.ndarray]:
    """For every row, how many points of the range's rows have each of its keys."""
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return np.split(count[inverse], np.cumsum([len(k) for k in keys])[:-1])


def common_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, n, common)`` of every row: its set's size and how many of it other rows have.

    ``common`` may be too large where two hashes agree in all the bits kept.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    ranges = range_count(docs)
    kind = rows.schema["_id"].dataType.simpleString()
    ids_type = pa.list_(to_arrow_type(rows.schema["_id"].dataType))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in kernel.slices(batch, "_text", BLOCK):
                sets = _sets(part.column(1))
                chunks = list(_packed(number, sets, ranges))
                ids = part.column(0)
                # the block's own row goes round the ranges: a range number that no other has
                yield pa.RecordBatch.from_arrays([
                    pa.array([-1 - number], pa.int64()), pa.array([number]), pa.array([len(sets)], pa.int64()),
                    pa.array([None], pa.binary()), pa.array([None], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([[len(s) for s in sets]], pa.list_(pa.int64()))], [*_PACKED.names, "ids", "sizes"])
                if chunks:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, t) for c, t in zip(zip(*chunks), _PACKED.types)),
                         pa.nulls(len(chunks), pa.list_(ids.type)), pa.nulls(len(chunks), pa.list_(pa.int64()))],
                        [*_PACKED.names, "ids", "sizes"])
                number += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: list, at: list, counts: list, ids: pa.Array, sizes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(block, pa.int64()), pa.array(at, pa.binary()), pa.array(counts, pa.binary()), ids,
                pa.array(sizes, pa.list_(pa.int64()))], ["block", "at", "counts", "ids", "sizes"])

        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array([k is None for k in batch.column(3).to_pylist()], pa.bool_()))
                if own.num_rows:
                    none = [None] * own.num_rows
                    whole.append(out(own.column(1).to_pylist(), none, none, own.column(5), own.column(6).to_pylist()))
                yield batch.filter(pa.array([k is not None for k in batch.column(3).to_pylist()], pa.bool_())).select(_PACKED.names)

        whole: list[pa.RecordBatch] = []
        for rows_ in held_by_range(packed()):
            yield from whole
            whole.clear()
            some = []  # only points with a common hash in this range
            for row, df in zip(rows_, _frequencies(rows_)):
                common = np.bincount(np.frombuffer(row["owner"], np.uint16)[df >= 2])
                at = np.flatnonzero(common)
                if len(at):
                    some.append((row["block"], at.astype("<u2").tobytes(), common[at].astype("<u4").tobytes()))
            if some:
                yield out(*map(list, zip(*some)), pa.nulls(len(some), ids_type), [None] * len(some))
        yield from whole

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums, ids, sizes = None, np.empty(0), None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sums[:len(sizes)])], ["_id", "n", "common"])

        for batch in batches:
            for i, (block, at, counts, own) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)))):
                if block != number:
                    if number is not None:
                        yield row()
                    number, sums = block, np.zeros(1 << 16, np.int64)
                if counts is None:
                    ids, sizes = batch.column(3).slice(i, 1).flatten(), own
                else:
                    sums[np.frombuffer(at, "<u2")] += np.frombuffer(counts, "<u4")
        if number is not None:
            yield row()

    spreads = rows.mapInArrow(tidy(spread), f"range bigint, block bigint, points bigint, keys binary, owner binary, "
                                      f"ids array<{kind}>, sizes array<bigint>")
    counts = spreads.repartition("range").sortWithinPartitions("range").mapInArrow(
        tidy(count), f"block bigint, at binary, counts binary, ids array<{kind}>, sizes array<bigint>")
    return written(counts.repartition("block").sortWithinPartitions("block").mapInArrow(
        tidy(total), f"_id {kind}, n bigint, common bigint"), "jaccard-common")


def may_link(common: Column, n: Column) -> Column:
    """False where the lone share alone keeps every other point away."""
    return (n > 0) & (100 * common >= PERCENT * n)


# --- points and their cells --------------------------------------------------

def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def points_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, n, content, point, hashes)`` of every row; equal sets are one point.

    ``content`` is the MD5 of the text; ``hashes`` is there for the first row
    of a task with this point only.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in kernel.slices(batch, "_text", BLOCK // 4):
                sets = _sets(part.column(1))
                names = [_digest(s) for s in sets]
                packed = []
                for name, s in zip(names, sets):
                    packed.append(None if name in seen else s.astype("<u8").tobytes())
                    seen.add(name)
                content = [hashlib.md5(t.encode()).digest() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(content, pa.binary()),
                    pa.array(names, pa.binary()), pa.array(packed, pa.binary())],
                    ["_id", "n", "content", "point", "hashes"])

    return written(rows.mapInArrow(tidy(run), f"_id {kind}, n bigint, content binary, point binary, hashes binary"),
                   "jaccard-points")


def cells_of(points: DataFrame) -> DataFrame:
    """``(pid, point, n, lone, hashes, profile, cells)`` of the points that may have partners.

    ``points`` are ``(point, hashes)``, repeated or not; ``pid`` numbers them.
    ``cells`` are the common ones
    of the first ``floor(0.2 n) + 1`` hashes in the order of frequency, then
    hash: a linked pair has one of them in common.  ``profile`` counts a
    point's common hashes in ``SLOTS`` parts of the hash's range.
    """
    ranges = range_count(points)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 40, [], 0
        seen: set[bytes] = set()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([[k for k, _ in held]], pa.list_(pa.binary())),
                                               pa.array([[h for _, h in held]], pa.list_(pa.binary()))],
                                              ["block", "names", "sets"])

        for batch in batches:
            for name, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name in seen:
                    continue
                seen.add(name)
                held.append((name, hashes))
                size += len(hashes)
                if size >= BLOCK:
                    yield row()
                    number, held, size = number + len(held), [], 0
        if held:
            yield row()

    # a block's number is that of its first point
    blocks = written(points.select("point", "hashes").repartition("point").mapInArrow(tidy(gather), "block bigint, names array<binary>, sets array<binary>"), "jaccard-blocks")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunks = [(r, b, keys) for r, b, _, keys, _ in
                          _packed(number, [np.frombuffer(s, "<u8") for s in sets], ranges)]
                if chunks:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunks), (pa.int64(), pa.int64(), pa.binary()))],
                                                     ["range", "block", "keys"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held_by_range(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["range"] for r in rows], pa.int64()),
                pa.array([np.minimum(f, (1 << 32) - 1).astype("<u4").tobytes() for f in _frequencies(rows)], pa.binary())],
                ["block", "range", "counts"])

    def choose(number: int, names: list[bytes], sets: list[bytes], counts: dict[int, bytes]) -> Iterator[tuple]:
        hashes = [np.frombuffer(s, "<u8") for s in sets]
        flat = np.concatenate(hashes)
        order, bounds = by_range(flat, ranges)
        df = np.empty(len(flat), np.uint32)
        for r, raw in counts.items():
            df[order[bounds[r]:bounds[r + 1]]] = np.frombuffer(raw, "<u4")
        at = 0
        for k, (name, h, raw) in enumerate(zip(names, hashes, sets)):
            n, own = len(h), df[at:at + len(h)]
            at += n
            lone = int((own == 1).sum())
            if 100 * (n - lone) >= PERCENT * n:
                shared = np.flatnonzero(own > 1)
                first = shared[np.lexsort((h[shared], own[shared]))][:n - -(-PERCENT * n // 100) + 1 - lone]
                profile = np.bincount((h[shared] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
                yield number + k, name, n, lone, raw, profile.astype("<u4").tobytes(), h[first].view(np.int64).tolist()

    schema = pa.schema([("pid", pa.int64()), ("point", pa.binary()), ("n", pa.int64()), ("lone", pa.int64()),
                        ("hashes", pa.binary()), ("profile", pa.binary()), ("cells", pa.list_(pa.int64()))])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names, sets, counts = None, [], [], {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(choose(number, names, sets, counts))
            for low in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low:low + 500]), schema.types)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != number:
                    if number is not None:
                        yield from out()
                    number, counts = row["block"], {}
                if row["range"] < 0:
                    names, sets = row["names"], row["sets"]
                else:
                    counts[row["range"]] = row["counts"]
        if number is not None:
            yield from out()

    counts = blocks.select("block", "sets").mapInArrow(tidy(spread), "range bigint, block bigint, keys binary").repartition(
        "range").sortWithinPartitions("range").mapInArrow(tidy(count), "block bigint, range bigint, counts binary")
    both = blocks.withColumns({"range": F.lit(-1).cast("long"), "counts": F.lit(None).cast("binary")}).unionByName(
        counts, allowMissingColumns=True)
    return written(both.repartition("block").sortWithinPartitions("block", "range").mapInArrow(
        tidy(combine), "pid bigint, point binary, n bigint, lone bigint, hashes binary, profile binary, cells array<bigint>"), "jaccard-cells")


# --- 2. and 3. regions and pivots --------------------------------------------

def _bound(n1: str, l1: str, n2: str, l2: str) -> Column:
    """The largest possible overlap of two points: that of their cores."""
    return F.least(F.col(n1) - F.col(l1), F.col(n2) - F.col(l2))


def _similar(overlap: Column, n1: Column, n2: Column) -> Column:
    return 100 * overlap >= PERCENT * (n1 + n2 - overlap)


def _distance(overlap: Column, n1: Column, n2: Column) -> Column:
    return 1.0 - overlap / (n1 + n2 - overlap)


def overlaps(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the size of the points' intersection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            sizes = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())],
                                             ["a", "b", "overlap"])

    sets = points.select("pid", "hashes")
    joined = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
    return joined.mapInArrow(tidy(run), "a bigint, b bigint, overlap bigint")


def _held_against(members: DataFrame, points: DataFrame, every: bool) -> DataFrame:
    """Members with their region's pivot: linked, open, and the (least) distance ``low``."""
    best = members.groupBy("cell").agg(F.min(F.struct(
        (F.col("lone") / F.col("n")).alias("share"), F.col("pid").alias("p"), F.col("n").alias("pn"),
        F.col("lone").alias("pl"))).alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = members.join(best, "cell").select("cell", "pid", "n", "lone", "best.p", "best.pn", "best.pl")
    most = _bound("n", "lone", "pn", "pl")
    pairs = rows.where((F.col("pid") != F.col("p")) & _similar(most, F.col("n"), F.col("pn")))
    found = overlaps(pairs.select(F.col("pid").alias("a"), F.col("p").alias("b")).distinct(), points)
    rows = rows.join(found.withColumnsRenamed({"a": "pid", "b": "p"}), ["pid", "p"], "left")
    itself = F.col("pid") == F.col("p")
    linked = itself | F.coalesce(_similar(F.col("overlap"), F.col("n"), F.col("pn")), F.lit(False))
    return written(rows.select(
        "cell", "pid", "n", "lone", "p", linked.alias("linked"),
        (~itself if every else ~linked).alias("open"),
        F.when(itself, 0.0).otherwise(_distance(F.coalesce("overlap", most), F.col("n"), F.col("pn"))).alias("low"),
        (itself | F.col("overlap").isNotNull()).alias("exact")), "jaccard-round")


def _possible_pairs(left: list[dict], right: list[dict], across: bool = False) -> list[tuple[int, int]]:
    """Pairs of a left and a right member that may link, one of them open at least.

    A pair is out if the overlap of its cores, part by part of the hash's
    range, is too small, or if its distances to the region's pivot differ by
    more than a link spans.  ``across``: only pairs of an open and a linked
    member.
    """
    def columns(members: list[dict]) -> tuple[np.ndarray, ...]:
        return (*(np.array([m[c] for m in members]) for c in ("pid", "n", "open", "low", "exact")),
                np.stack([np.frombuffer(m["profile"], "<u4") for m in members]).astype(np.int64))

    if not left or not right:
        return []
    far, out = 1 - PERCENT / 100 + 1e-9, []
    pid, n, open_, low, exact, profile = columns(right)
    for one in zip(*columns(left)):
        most = np.minimum(one[5], profile).sum(1)
        fits = 100 * most >= PERCENT * (one[1] + n - most)
        fits &= ~(exact & (one[3] > low + far)) & ~(one[4] & (low > one[3] + far))
        fits &= (one[2] != open_) if across else (one[2] | open_)
        out += [(min(int(one[0]), b), max(int(one[0]), b)) for b in pid[fits & (pid != one[0])].tolist()]
    return out


def _leaf_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's members, the pairs that may link."""
    for batch in batches:
        for i in range(batch.num_rows):
            members = batch.column(0)[i].as_py()
            pairs = sorted(set(_possible_pairs(members, members)))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])


_MEMBER = ("pid", "n", "open", "low", "exact", "profile")


def _block_pairs(rows: DataFrame, across: bool = False) -> DataFrame:
    """The same for regions of any size, by pairs of blocks of about ``LEAF`` members."""
    sizes = rows.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("blocks"))
    own = rows.join(sizes, "p").withColumn("own", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def run(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        both = members.to_dict("records")
        pairs = set(_possible_pairs([m for m in both if m["own"] == i], [m for m in both if m["own"] == j], across))
        return pd.DataFrame(sorted(pairs), columns=["a", "b"])

    return dealt.select("p", "i", "j", "own", *_MEMBER).groupBy("p", "i", "j").applyInPandas(run, "a bigint, b bigint")


def links(points: DataFrame, all_links: bool = False) -> DataFrame:
    """``(a, b)``: links between the points of ``cells_of``, by their ``pid``.

    All of them, or enough of them to connect what is connected.
    """
    members = points.select(F.explode("cells").alias("cell"), "pid", "n", "lone")
    spark = points.sparkSession
    stars = spark.createDataFrame([], "a bigint, b bigint")
    rest = stars
    far = 1 - PERCENT / 100 + 1e-9
    for number in range(ROUNDS):
        held = _held_against(members, points, all_links)
        stars = stars.union(held.where(F.col("linked") & (F.col("pid") != F.col("p"))).select(
            F.col("pid").alias("a"), F.col("p").alias("b")).distinct())
        # what follows goes by pivots, not cells: points that share many cells share a pivot in most of them;
        # an open member may link to a linked one only across the triangle's window
        # (what is joined by pivot is made distinct and written before, so that a frequent pivot's rows can be split)
        near = written(held.select("p", "pid", "n", "open", "low", "exact", "linked").distinct(), "jaccard-near")
        state = written(near.where("open").groupBy("p").agg(F.min("low").alias("least")), "jaccard-state")
        kept = written(near.join(state.hint("merge"), "p").where(
            F.col("open") | (F.col("linked") & (F.lit(not all_links)) & (F.col("least") <= F.col("low") + far))).select(
            "p", "pid", "n", "open", "low", "exact"), "jaccard-kept")
        sizes = written(kept.groupBy("p").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "jaccard-sizes")
        kept = kept.join(sizes.hint("merge"), "p").join(points.select("pid", "profile"), "pid").select("p", "m", *_MEMBER)
        small = kept.where(F.col("m") <= LEAF).groupBy("p").agg(F.array_sort(F.collect_list(F.struct(*_MEMBER))).alias("members"))
        rest = rest.union(small.select("members").mapInArrow(tidy(_leaf_pairs), "a bigint, b bigint"))
        large = written(kept.where(F.col("m") > LEAF), "jaccard-large")
        if large.isEmpty():
            break
        if number == ROUNDS - 1:
            rest = rest.union(_block_pairs(large))
        else:  # open members go on as a region; across to the linked ones now
            if not all_links:
                closed = large.where(~F.col("open")).select("p").distinct()
                rest = rest.union(_block_pairs(large.join(closed, "p", "left_semi"), across=True))
            members = held.where("open").join(large.select("p").distinct(), "p", "left_semi").select("cell", "pid", "n", "lone")
    stars = written(stars.distinct(), "jaccard-stars")
    rest = rest.distinct()
    if not all_links:
        own = components(stars)
        rest = (rest.join(own.toDF("a", "ra"), "a", "left").join(own.toDF("b", "rb"), "b", "left")
                .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    size = points.select("pid", "n")
    checked = overlaps(rest, points).join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(
        _similar(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")
    return stars.union(checked)


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that no other can link to, the others with ``root``, a point of their component)."""
    sized = common_counts(docs, id_col, text_col)
    some = sized.where(may_link(F.col("common"), F.col("n"))).select(F.col("_id").alias("_some")).distinct()
    single = sized.join(some, F.col("_id").eqNullSafe(F.col("_some")), "left_anti").select("_id", "n")
    # by a shuffle at every size: these ids grow with the table and are never broadcast
    rows = points_of(docs.join(some.hint("merge"), F.col(id_col).eqNullSafe(F.col("_some")), "left_semi"), id_col, text_col)
    points = cells_of(rows.where("hashes is not null and n > 0"))
    own = written(components(links(points)).join(points.select(F.col("pid").alias("node"), "point"), "node").select(
        "point", F.col("root").cast("string").alias("root")), "jaccard-components")
    rows = rows.select("_id", "n", "content", "point").join(own, "point", "left")
    return single, rows.select("_id", "n", "content", F.coalesce("root", F.hex("point")).alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id)`` of every row."""
    single, rows = _grouped(docs, id_col, text_col)
    rows = written(rows.select("_id", "n", "root"), "jaccard-roots")
    least = written(rows.where("n > 0").groupBy("root").agg(F.min("_id").alias("_least")), "jaccard-least")
    grouped = rows.join(least.hint("merge"), "root", "left").select(
        "_id", "n", F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"))
    return grouped.unionByName(single.withColumn("component_id", F.col("_id"))).withColumnsRenamed(
        {"_id": id_col, "n": "n_shingles"})


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, then content, then row number.

    Rows equal in id and text are rows like others.  Row numbers are fixed by
    writing the rows to the shared folder first.
    """
    stamped = written(docs.withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
    _, rows = _grouped(stamped, "_row", text_col)
    ids = stamped.select(F.col("_row").alias("_id"), F.col(id_col).alias("_own"))
    # by a shuffle at every size, as these rows grow with the table
    rows = rows.where("n > 0").join(ids.hint("merge"), "_id")
    name = F.struct(F.col("_own").isNull().alias("no_id"), F.col("_own").alias("own"), F.col("content").alias("content"),
                    F.col("_id").alias("row"))
    rows = written(rows.select("root", "_id", name.alias("name")), "jaccard-named")
    first = written(rows.groupBy("root").agg(F.min("name")["row"].alias("_first")), "jaccard-first")
    gone = rows.join(first.hint("merge"), "root").where("_id != _first").select(F.col("_id").alias("_row"))
    return stamped.join(gone.hint("merge"), "_row", "left_anti").select(*docs.columns)
