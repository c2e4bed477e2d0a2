import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from reelhouse.llm import prefix_trie
from reelhouse.llm.scan import running_sums
from tests.llm.helpers import WORD

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    """Rows (conv_id, turn, role, text), with more columns that have names of the operator's own."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, depth int, p1 string, one long")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, s in sorted(whole.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[:len(p)] == p]
        has_child = {q[:-1] for q in members if q}
        ends = ",".join(str(c) for c in convs if whole[c] == p)
        out.append((convs[0], len(p), members[p[:-1]][0] if p else None, len(convs),
                    sum(len(q) == len(p) + 1 for q in under), sum(q not in has_child for q in under),
                    sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = prefix_trie.prefix_trie(table(spark, rows))
    assert got.columns == COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_random_conversations(spark):
    r = random.Random(12)
    rows = []
    for c in range(130):
        if c % 20 or c % 40:  # some bases are absent
            rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "d e f", "g\th"]))
                     for t in range(r.randrange(1, 7))]
    r.shuffle(rows)
    check(spark, rows)


def test_copies_ties_nulls_and_missing_ids(spark):
    same = [(c, t, "user", f"turn {t} x") for c in range(1, 60) for t in range(4)]
    odd = [(500, None, None, None), (500, None, "user", "b"), (500, 1, "user", "a"), (500, 1, "user", "a"),
           (501, 3, "", ""), (501, 2, None, "é \x85 日"), (None, 1, "user", "lost"), (None, None, None, None),
           (520, 1, "user", "only"), (521, 1, "user", "only"), (522, 9, "user", "z" * 5000)]
    check(spark, same + odd)


def test_one_conversation_holds_most_turns(spark):
    rows = [(40, t, "user", f"w{t % 3}") for t in range(300)] + [(41, t, "user", f"w{t % 3}") for t in range(290)]
    rows += [(c, 0, "user", "hi there") for c in range(100, 140)]
    check(spark, rows)


def test_turnless_and_empty(spark):
    lone = [(c, 0, "user", "x") for c in range(21, 40)]  # no base: some have no turn left
    check(spark, lone)
    assert any(zlib.crc32(str(c).encode()) % 4 for c, *_ in lone)
    assert prefix_trie.prefix_trie(table(spark, [])).collect() == []


def test_running_sums_cross_tasks(spark):
    rows = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 3 + 10).cast("long").alias("k"), F.col("id").alias("i"),
        ((F.col("id") * 2654435761) % (1 << 59)).alias("n"))
    got = running_sums(rows, "k", [F.col("i")], ["n"], "test").collect()
    assert len(got) == 5000
    sums = defaultdict(int)
    for r in sorted(got):
        sums[r.k] = (sums[r.k] + r.n) % (1 << 60)
        assert r.n_sum == sums[r.k]
