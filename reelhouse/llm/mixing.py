"""Mixing sources to target weights by weighted fair queueing (operator 2).

Every source has a weight and gets a target number of words; its documents are
shuffled (by a digest of their id) and served in that order, as often as the
repeat limit allows.  A document's virtual finish time is the words its source
has served with it, divided by the source's target.  All documents are sorted
by that time and the order is cut where the total budget is used up; the
document that its source's target ends in is served in part.

Running totals come from two range sorts of narrow rows; a hot source spreads
over many ranges, as the shuffle key is part of the order.  Nothing but one
row of totals a filling round reaches the driver.

Cases: a null source is a source of its own, last in order; null ids and
repeated rows are documents like others (rows equal in id, source and size are
interchangeable); null or empty texts have size 0 and are never taken; a table
without words has targets 0; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelhouse.llm.common import text_of, written
from reelhouse.llm.order import running

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix for each word of the sources.
SHARE = 1.5
#: Times a document may be served.
REPEATS = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, earlier_size, target)``: the budget shared by weight.

    A target stops at ``repeats`` times its source's size; the excess is shared
    again by weight among the others, until none is above.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % n + 1).cast("int"))
    rows = running(sources, [F.col("source").asc_nulls_last()], "source_size", "mix-sources").select(
        "source", "source_size", F.col("_before").alias("earlier_size"), weight.alias("weight"),
        (F.col("source_size") * repeats).cast("double").alias("cap"))
    budget = F.sum("source_size") * share
    level = 0.0
    while True:  # each round stops one source more at least; the level only rises
        full = F.col("cap") <= F.col("weight") * level
        total, stopped, open_weight = rows.agg(
            budget, F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        risen = ((total or 0.0) - (stopped or 0.0)) / open_weight if open_weight else level
        if risen <= level:
            break
        level = risen
    return rows.select("source", "source_size", "earlier_size",
                       F.least("cap", F.col("weight") * level).alias("target"))


def schedule(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
             repeats: int = REPEATS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, servings) for rows ``(id, source, size)`` and what else they carry.

    documents: every row, its source's totals and ``row``, its place in the
    shuffled order.  servings: ``(row, pass, position, finish, taken)`` of every
    document served, in the order of the mix.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary"))
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("id"), F.col("size")]
    shuffled = running(sized.withColumn("_key", key), order, "size", "mix-shuffled")
    goal = targets(sized, weights, share, repeats).withColumnRenamed("source", "_source")
    docs = written(shuffled.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select(
        *sized.columns, "source_size", "target", F.col("_at").alias("row"),
        (F.col("_before") - F.col("earlier_size")).alias("start")), "mix-documents")

    begin = F.col("start") + F.col("pass") * F.col("source_size")
    served = F.least(F.col("size"), F.floor("target") - begin)
    queue = docs.where(F.col("size") > 0).select("*", F.explode(F.array(*[F.lit(k) for k in range(repeats)])).alias("pass"))
    queue = queue.select("row", "pass", served.alias("served"),
                         ((begin + F.col("size")) / F.col("target")).alias("finish")).where(F.col("served") > 0)
    budget = docs.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) * share)).first()[0]
    mixed = running(queue, [F.col("finish"), F.col("row"), F.col("pass")], "served", "mix-queue")
    servings = mixed.select("row", "pass", F.col("_at").alias("position"), "finish",
                            F.least(F.col("served"), F.lit(budget) - F.col("_before")).alias("taken"))
    return docs, servings.where(F.col("taken") > 0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        **how) -> DataFrame:
    """``(id, size, source_size, target, taken, n_servings)`` of every document."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        word_count(text_of(text_col)).alias("size"))
    every, servings = schedule(sized, **how)
    taken = servings.groupBy("row").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n_servings"))
    return every.join(taken, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("n_servings", F.lit(0)).alias("n_servings"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    **how) -> DataFrame:
    """The rows of ``docs`` that the mix serves, once for each serving, and ``mix_position``.

    A serving in part has the text's first words only.  Row numbers are fixed
    by writing the rows to the shared folder first.
    """
    stamped = written(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    sized = stamped.select("_row", F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                           word_count(text_of(text_col)).alias("size"))
    every, servings = schedule(sized, **how)
    served = servings.join(every.select("row", "_row", "size"), "row").select(
        "_row", F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("position").alias("mix_position"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)),
                                1, F.col("_taken").cast("int")), "")
    rows = stamped.join(served, "_row").withColumn(
        text_col, F.when(F.col("_taken") < F.col("_size"), part).otherwise(F.col(text_col)))
    return rows.select(*docs.columns, "mix_position")


#: The same mix in DuckDB SQL (tables: documents).
MIX_SQL = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
src as (
  select source, sum(size)::bigint as source_size,
    [3.0, 1.0, 2.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight
  from sized group by source),
fill as (
  select 0.0::double as level, 0 as round
  union all
  select risen, round + 1 from (
    select f.level, f.round,
      (select (sum(s.source_size)::double * 1.5
               - coalesce(sum(2.0::double * s.source_size) filter (2 * s.source_size <= s.weight * f.level), 0))
              / sum(s.weight) filter (2 * s.source_size > s.weight * f.level) from src s) as risen
    from fill f) where risen > level),
goal as (
  select source, source_size, least(2.0::double * source_size, weight * (select max(level) from fill)) as target from src),
queue as (
  select d.doc_id, d.size, g.source_size, g.target,
    coalesce(sum(d.size) over (partition by d.source order by md5('mix:' || d.doc_id::varchar), d.doc_id
                               rows between unbounded preceding and 1 preceding), 0) as start
  from sized d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target) - start))
   + greatest(0, least(size, floor(target) - start - source_size)))::bigint as taken
from queue
"""
