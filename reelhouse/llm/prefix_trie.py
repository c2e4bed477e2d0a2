"""Conversation prefix trie by collapsing whole sequences (operator 12).

Every conversation is rebuilt: the first ``h`` turns of its base conversation
(``c - c % 20``), then its own turns after its first ``h``.  Identical rebuilt
conversations collapse into one weighted sequence with a list of the
conversations that end there; sequences that are a proper prefix of another
fall to an anti join, the rest are the leaves; each sequence's prefixes carry
its weight, and the prefixes' sums are the trie's nodes.

A prefix is named by its depth and a sum, modulo 2**60 in two lanes, of hashes
of (depth, digest of role and text); a running sum inside each conversation
gives all its prefixes, also when one conversation holds a third of all turns
(``scan``).  A node's smallest member owns it.  What a member owns is the end of
its path, so sums over a subtree need no pairs of a node and its ancestors:
each sequence adds, at each of its prefixes, what it owns from there on.

Members of a hot sequence leave the sort as text of many ids, so the task that
hashes its list reads a few rows.  A sequence's digest needs its ids in one
order and so one stream; memory stays at one chunk.

Cases: null roles and texts count as empty; a null turn comes first, turns that
tie go by role, then text; equal rows are turns each; rows without a conv_id
are no conversation and are left out; an empty table has no nodes; only the
four named columns are read.  Ids are whole numbers; ``%`` and ``h`` are taken
as SQL takes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelhouse.llm.common import tidy, written
from reelhouse.llm.scan import MODULUS, running_sums

#: Conversations that share a base.
FAMILY = 20
#: Turns taken from the base at most, and one more.
TAKEN = 4
#: Ids of one sequence that travel together as text.
CHUNK = 5000
NODE = ["depth", "p1", "p2"]


def taken(conv: Column) -> Column:
    """``h``: how many turns come from the base."""
    return F.crc32(conv.cast("string").cast("binary")) % TAKEN


def _lane(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, a, b, words)``: each conversation's own turns in order, from 1, by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"),
        F.lit(1).cast("long").alias("one"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranked = running_sums(rows, "conv_id", order, ["one"], "turns")
    return written(ranked.withColumn("digest", digest).select(
        "conv_id", F.col("one_sum").alias("at"), _lane(F.col("digest"), 1).alias("a"), _lane(F.col("digest"), 16).alias("b"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")), "turns")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, n_head)`` of every conversation, and its rebuilt turns ``(conv_id, depth, a, b, words)``."""
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < TAKEN)).groupBy(
        F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "words"))).alias("head"))
    convs = own.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    # a base has at most three turns here, and twenty conversations
    convs = written(convs.join(heads, "base", "left").select("conv_id", F.expr(
        f"slice(coalesce(head, array()), 1, cast(crc32(cast(cast(conv_id as string) as binary)) % {TAKEN} as int))")
        .alias("head")).withColumn("n_head", F.size("head").cast("long")), "conversations")
    first = convs.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.at").alias("depth"), "t.a", "t.b", "t.words")
    # two bare shuffles: the turns of a long conversation can be split
    later = own.where(F.col("at") > taken(F.col("conv_id"))).join(
        convs.select("conv_id", "n_head").hint("merge"), "conv_id").select(
        "conv_id", (F.col("n_head") + F.col("at") - taken(F.col("conv_id"))).alias("depth"), "a", "b", "words")
    return convs.select("conv_id"), first.union(later)


def paths(sequence_turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, p1, p2, q1, q2, words)``: each prefix of each rebuilt conversation, and the one before."""
    mask = F.lit(MODULUS - 1)
    rows = sequence_turns.select(
        "conv_id", "depth", F.xxhash64("a", "b", "depth").bitwiseAND(mask).alias("h1"),
        F.xxhash64("depth", "b", F.lit(1), "a").bitwiseAND(mask).alias("h2"), "words")
    found = running_sums(written(rows, "rebuilt"), "conv_id", [F.col("depth")], ["h1", "h2"], "paths")
    before = [(F.col(f"h{i}_sum") - F.col(f"h{i}")).bitwiseAND(mask).alias(f"q{i}") for i in (1, 2)]
    return written(found.select("conv_id", "depth", F.col("h1_sum").alias("p1"), F.col("h2_sum").alias("p2"),
                                *before, "words"), "paths")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one sequence as text; rows come sorted by sequence and id."""
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        ids = batch.column(3).to_pylist()
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new | (np.arange(batch.num_rows) % CHUNK == 0))
        ends = np.append(starts[1:], batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(k[starts]) for k in keys], pa.array([ids[s] for s in starts], pa.int64()),
             pa.array([",".join(map(str, ids[s:e])) for s, e in zip(starts, ends)], pa.string())],
            [*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's ids; chunks come sorted by sequence and first id."""
    now, state = None, None
    for batch in batches:
        out = []
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield _named(out)
    if now is not None:
        yield _named([(*now, state.hexdigest())])


def _named(rows: list[tuple]) -> pa.RecordBatch:
    *keys, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys], pa.array(digest, pa.string())],
                                      [*NODE, "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """``(depth, p1, p2, ends_sha256)`` of every sequence of ``members (depth, p1, p2, conv_id)``."""
    kind = "depth bigint, p1 bigint, p2 bigint"
    chunks = members.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(
        *NODE, "conv_id").mapInArrow(tidy(_chunks), f"{kind}, first bigint, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        tidy(_digests), f"{kind}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``.
    """
    zero, none = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    convs, sequence_turns = rebuilt(turns(conversations))
    path = paths(sequence_turns)

    # identical conversations collapse into one sequence, for which the smallest stands
    full = path.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("s"))
    members = written(convs.join(full, "conv_id", "left").select(
        *[F.coalesce(F.col(f"s.{c}"), zero).alias(c) for c in NODE], "conv_id"), "members")
    sequences = written(members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "sequences")

    # the weighted prefixes of the sequences; every one starts at the root
    stands = sequences.select("conv_id", "weight", F.col("depth").alias("length"))
    weighted = written(path.join(stands.hint("merge"), "conv_id").select(
        "conv_id", "weight", "length", *NODE, "q1", "q2", "words").union(
        stands.select("conv_id", "weight", "length", *[zero] * 6)), "prefixes")
    proper = weighted.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti")

    nodes = written(weighted.select("conv_id", "weight", *NODE, "q1", "q2", "words", zero.alias("leaf")).union(
        leaves.select("conv_id", zero, *NODE, *[F.lit(None).cast("long")] * 3, F.lit(1).cast("long"))).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.max("words").alias("words"), F.max("leaf").alias("leaf")), "nodes")

    # what each sequence owns from a prefix on; the key is unique on both sides
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "leaf")
    values = weighted.select("conv_id", *NODE).join(owned, ["conv_id", "depth"], "left").select(
        "conv_id", *NODE, *[F.coalesce(c, zero).alias(c) for c in ("saved", "leaf")])
    subtree = running_sums(written(values, "owned"), "conv_id", [F.col("depth").desc()], ["saved", "leaf"], "subtrees")

    # hot nodes are added up before the shuffle
    parts = nodes.select(*NODE, "conv_id", "n_convs", "q1", "q2", zero.alias("children"), zero.alias("leaves"),
                         zero.alias("saved"), F.lit(None).cast("string").alias("digest"))
    blank = [F.lit(None).cast("long")] * 4
    parts = parts.union(nodes.where("depth > 0").select(F.col("depth") - 1, "q1", "q2", *blank, F.lit(1).cast("long"),
                                                        zero, zero, F.lit(None).cast("string")))
    parts = parts.union(subtree.select(*NODE, *blank, zero, "leaf_sum", "saved_sum", F.lit(None).cast("string")))
    parts = parts.union(ends(members).select(*NODE, *blank, zero, zero, zero, "ends_sha256"))
    found = written(parts.groupBy(*NODE).agg(
        F.max("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.max("digest"), F.lit(none)).alias("ends_sha256")), "trie")

    # two bare shuffles: the children of a node with very many can be split
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("conv_id").alias("parent_conv_id"))
    return found.join(parents.hint("merge"), ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: DuckDB SQL for the trie of ``conversations``; crc32 bit by bit.
TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS ts FROM t GROUP BY conv_id),
sized AS (
  SELECT conv_id, ts, xor(list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: i::UBIGINT)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
    4294967295::UBIGINT) % 4 AS h FROM own),
seq AS (
  SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h::BIGINT], []), o.ts[o.h::BIGINT + 1:]) AS s
  FROM sized o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
pre AS (SELECT conv_id, d AS depth, s[1:d] AS p, d = len(s) AS whole FROM seq, LATERAL unnest(range(0, len(s) + 1)) AS r(d)),
nodes AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0
      ELSE len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM pre GROUP BY depth, p),
linked AS (
  SELECT n.depth, n.p, max(q.conv_id) AS parent_conv_id FROM nodes n
  LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1] GROUP BY n.depth, n.p),
kids AS (
  SELECT n.depth, n.p, count(c.depth) AS n_children FROM nodes n
  LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p GROUP BY n.depth, n.p),
below AS (
  SELECT n.depth, n.p, sum(m.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM nodes n JOIN nodes m ON m.depth >= n.depth AND m.p[1:n.depth] = n.p
  JOIN kids k ON k.depth = m.depth AND k.p = m.p GROUP BY n.depth, n.p)
SELECT conv_id, n.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM nodes n JOIN linked l ON l.depth = n.depth AND l.p = n.p JOIN kids k ON k.depth = n.depth AND k.p = n.p
JOIN below b ON b.depth = n.depth AND b.p = n.p
"""
