"""Categorisation (M5 constrained, M6 free with validation and retries).

The built-in deterministic categoriser scores each candidate category by
keyword overlap: a candidate's keywords are the tokens of its name, an
item's score for it is the number of the item's text tokens that are among
those keywords.  It is computed as joins and grouped counts:

    item tokens (exploded in place)  SEMI JOIN  candidate keywords  on token
      -> count per (item, token)  JOIN  candidate keywords  on token
      -> count per (item, candidate)  -> best candidate per item

Tokens that no candidate has are dropped where they are made.  The others are
counted per item before the join (combined map side, so an item with a third of
all tokens leaves each task as one row a keyword).  The keywords are a small
written table, so that Spark knows their bytes and decides by them how they are
joined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelhouse import constants as K
from reelhouse.functions import text as TX
from reelhouse.operators.vocabulary import is_valid_answer, membership
from reelhouse.session import checkpoint_dir


def keywords(vocab: DataFrame) -> DataFrame:
    """``(category, token)`` for every distinct token of every candidate name."""
    return vocab.select("category", F.explode(TX.tokens("category")).alias("token")).distinct()


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared scratch folder, of a known size."""
    path = f"{checkpoint_dir(rows.sparkSession)}/keywords-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scores(items: DataFrame, key: str, text: F.Column, vocab: DataFrame) -> DataFrame:
    """``(key, category, score)`` for candidates with a positive score.

    Only tokens that are keywords are counted, so a task holds as many counts as
    its items say keywords, not words.  An item's equal tokens are counted before
    the join, so a token said a thousand times joins once.
    """
    words = _written(keywords(vocab))
    toks = items.select(key, F.explode(TX.tokens(text)).alias("token")).join(words, "token", "left_semi").groupBy(
        key, "token").agg(F.count(F.lit(1)).alias("times"))
    return toks.join(words, "token").groupBy(key, "category").agg(F.sum("times").alias("score"))


def categorize(items: DataFrame, key: str, text: F.Column, vocab: DataFrame,
               out_col: str = "category", **kw) -> DataFrame:
    """M5: the best-scoring candidate (ties: smaller name), NULL when none scores.

    Returns ``items`` with ``out_col`` added.
    """
    sc = scores(items, key, text, vocab, **kw)
    best = sc.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b")) \
             .select(key, F.col("b.category").alias(out_col))
    base = items.drop(out_col) if out_col in items.columns else items
    return base.join(best, key, "left")


def ranked(items: DataFrame, key: str, text: F.Column, vocab: DataFrame, top: int, **kw) -> DataFrame:
    """``(key, rank, category)`` for the ``top`` best candidates of each item.

    The window runs per item over that item's scored candidates, at most the
    vocabulary size.
    """
    sc = scores(items, key, text, vocab, **kw)
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("category"))
    return sc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top) \
             .select(key, "rank", "category")


def categorize_free(items: DataFrame, key: str, text: F.Column, vocab: DataFrame,
                    library: DataFrame, out_col: str = "category",
                    retries: int = K.CATEGORY_RETRIES, **kw) -> DataFrame:
    """M6: free category with validation and bounded retries.

    Attempt k proposes the k-th best candidate not yet rejected (then
    "Uncategorized" once candidates run out).  An answer is accepted when it
    is valid (J2 known, no double quote, at most three words).  A rejected
    answer of more than three words is not remembered, so it would be
    proposed again and ends as "Uncategorized".  After ``retries`` retries the
    last answer is taken as it is.  The proposals of all attempts are
    computed at once; the attempt loop becomes a minimum over ranks.
    """
    attempts = retries + 1
    # validity depends on the candidate only: decide it once per candidate
    cands = vocab.select("category").distinct().withColumn("answer", TX.clean_category("category"))
    cands = membership(cands, "answer", library, **kw)
    cands = cands.select("category", "answer",
                         is_valid_answer(F.col("known"), F.col("answer")).alias("valid"),
                         (TX.word_count("answer") > K.MAX_CATEGORY_WORDS).alias("too_long"))
    props = ranked(items, key, text, vocab, attempts, **kw) \
        .join(cands, "category")
    per_item = props.groupBy(key).agg(
        F.min(F.when(F.col("valid"), F.col("rank"))).alias("kv"),
        F.min(F.when(~F.col("valid") & F.col("too_long"), F.col("rank"))).alias("kl"),
        F.count(F.lit(1)).alias("m"),
        F.collect_list(F.struct("rank", "answer")).alias("_all"),
    )
    def pick(k):
        return F.try_element_at(F.filter("_all", lambda x: x["rank"] == k), F.lit(1))["answer"]

    chosen = (F.when(F.col("kv").isNotNull() & (F.col("kl").isNull() | (F.col("kv") < F.col("kl"))),
                     pick(F.col("kv")))
               .when(F.col("kl").isNotNull(), F.lit(K.UNCATEGORIZED))
               .when(F.col("m") >= attempts, pick(F.lit(attempts)))
               .otherwise(F.lit(K.UNCATEGORIZED)))
    res = per_item.select(key, TX.final_category(chosen).alias(out_col))
    base = items.drop(out_col) if out_col in items.columns else items
    out = base.join(res, key, "left")
    # items no candidate scored: every attempt proposes "Uncategorized"
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(K.UNCATEGORIZED)))
