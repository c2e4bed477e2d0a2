"""Model-backed text operators (M1-M4, M7): complete, summarise, theme, blurb.

The model is pluggable:

* an :class:`ExprModel` maps a chunk Column to an answer Column.  It runs
  inside the JVM, per row, with no shuffle (the built-in deterministic models
  are of this kind, so tests and the SQL oracle need no network);
* a :class:`BatchModel` wraps a Python function ``(instructions, texts) ->
  answers`` over lists.  Chunks become rows, are dealt by hash over the
  shuffle partitions and answered in batches of ``batch_size``; answers are
  checkpointed before they are read again, so a retried task never produces
  a second, different answer.  A call that fails is repeated text by text, and
  a text that still fails keeps its row: the answer is NULL and the error is
  in ``<column>_error``.

Whole texts are processed: every chunk of every text is answered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions import text as TX
from reelhouse.functions.fields import strip
from reelhouse.operators.joins import stable

#: A sentence of a chunk, for the built-in models.
SENTENCE = r"[^.!?]+[.!?]?"

# What a real model is asked for; the built-in models do not read it.
SUMMARY_INSTRUCTION = "Input: a video's title and transcript. Output: three to five plain sentences on who speaks and what is said. "
SHORTEN_INSTRUCTION = "Input: partial summaries of one transcript. Output: a single shorter text with no point made twice. "
THEMES_INSTRUCTION = "Input: a transcript. Output: one line per topic, each starting with a dash, five words at most. "
SHORTEN_THEMES_INSTRUCTION = "Input: several topic lists. Output: one list in the same form without equal or near-equal lines. "
BLURB_INSTRUCTION = "Input: a transcript. Output: one sentence that could stand under the title. "


@dataclass(frozen=True)
class ExprModel:
    """A model written as a Column expression over one chunk."""
    fn: Callable[[str, Column], Column]

    def answer(self, instruction: str, chunk: Column) -> Column:
        return self.fn(instruction, chunk)


@dataclass(frozen=True)
class BatchModel:
    """A Python model answering lists of (instruction, text) pairs, ``batch_size`` at a time.

    ``memo``: folder of the answers given so far; what was answered under the
    same ``version``, instruction and text is not asked again, whichever run,
    retry or shortening pass asked it.  Failed calls are not remembered.
    """
    fn: Callable[[list[str], list[str]], list[str]]
    batch_size: int = 64
    memo: str | None = None
    version: str = "1"


def _sentences(chunk: Column) -> Column:
    return F.regexp_extract_all(chunk, F.lit(SENTENCE), F.lit(0))


def _picked(sentences: Column, order: Callable[[Column], Column]) -> Column:
    """The sentence with the smallest ``order``, the earliest of equals; stripped."""
    ranked = F.transform(sentences, lambda s, i: F.struct(order(s).alias("o"), i.alias("i"), s.alias("s")))
    return strip(F.coalesce(F.array_min(ranked)["s"], F.lit("")))


def extract_model() -> ExprModel:
    """Deterministic summariser: the longest of all sentences of the chunk."""
    return ExprModel(lambda _i, c: _picked(_sentences(c), lambda s: -F.length(s)))


def short_model() -> ExprModel:
    """Deterministic blurb: the shortest sentence of the chunk."""
    return ExprModel(lambda _i, c: _picked(_sentences(c), lambda s: F.length(s)))


#: Terms a chunk contributes to the themes.
TERMS = 3


def terms_model() -> ExprModel:
    """Deterministic theme lister: the chunk's longest distinct terms, one a line."""
    def fn(_instruction: str, chunk: Column) -> Column:
        ranked = F.array_sort(F.transform(F.array_distinct(TX.tokens(chunk)), lambda t: F.struct((-F.length(t)).alias("o"), t.alias("t"))))
        return F.array_join(F.transform(F.slice(ranked, 1, TERMS), lambda r: F.concat(F.lit("- "), r["t"])), "\n")
    return ExprModel(fn)


def extract_batch_model(batch_size: int = 64) -> BatchModel:
    """The extracting summariser as a Python batch model (same answers)."""
    import re
    find = re.compile(SENTENCE).findall

    def fn(_instructions: list[str], texts: list[str]) -> list[str]:
        return [max(find(t) or [""], key=len).strip() for t in texts]
    return BatchModel(fn, batch_size)


def complete_expr(text: Column, instruction: str, model: ExprModel, chunk_size: int = K.MAX_TOKENS // 2) -> Column:
    """M1 with an expression model: chunk, answer each chunk, join, clean."""
    parts = TX.chunks(text, chunk_size)
    return TX.join_responses(F.transform(parts, lambda c: model.answer(instruction, c)))


MEMO_SCHEMA = "_d binary, _r string"


def remembered(spark: SparkSession, model: BatchModel) -> DataFrame:
    """``(_d, _r)``: the answers that ``model``'s memo holds for its version, one a digest."""
    path = f"{model.memo}/version={model.version}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MEMO_SCHEMA)
    return spark.read.schema(MEMO_SCHEMA).parquet(path).groupBy("_d").agg(F.min("_r").alias("_r"))


def answer_rows(rows: DataFrame, text_col: str, instruction: str, model: BatchModel) -> DataFrame:
    """``rows`` with ``_r``, the answer to ``text_col``, and ``_e``, the error instead of one.

    With a memo, each distinct text that it lacks is asked once and the answers
    are appended to it; texts meet digests only, answers are joined by digest.
    """
    if model.memo is None:
        return _asked(rows, text_col, instruction, model)
    spark = rows.sparkSession
    said = F.concat(F.lit(f"{len(instruction)}:{instruction}"), F.col(text_col))
    keyed = stable(rows.withColumn("_d", F.unhex(F.sha2(said.cast("binary"), 256))))
    known = remembered(spark, model)
    new = keyed.join(known, "_d", "left_anti").groupBy("_d").agg(F.first(text_col).alias(text_col))
    got = stable(_asked(new.repartition("_d"), text_col, instruction, model))
    got.where("_e is null").select("_d", "_r").write.mode("append").parquet(f"{model.memo}/version={model.version}")
    failed = got.where("_e is not null").select("_d", "_e")
    # read anew: what was just appended is part of it
    out = keyed.drop(text_col).join(remembered(spark, model), "_d", "left").join(failed, "_d", "left")
    return out.withColumn("_r", F.when(F.col("_e").isNull(), F.col("_r"))).select(
        *[c for c in rows.columns if c != text_col], "_r", "_e")


def _asked(rows: DataFrame, text_col: str, instruction: str, model: BatchModel) -> DataFrame:
    """``answer_rows`` that asks the model about every row."""
    fn, size = model.fn, model.batch_size

    def ask(texts: list[str]) -> tuple[list[str | None], list[str | None]]:
        try:
            out = list(fn([instruction] * len(texts), texts))
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} answers to {len(texts)} texts")
            return out, [None] * len(texts)
        except Exception as e:  # noqa: BLE001  any model error becomes the row's error
            if len(texts) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
            parts = [ask([t]) for t in texts]
            return [p[0][0] for p in parts], [p[1][0] for p in parts]

    def run(batches):
        for pdf in batches:
            answers, errors = [], []
            texts = pdf[text_col].tolist()
            for at in range(0, len(texts), size):
                got, bad = ask(texts[at:at + size])
                answers += got
                errors += bad
            yield pdf.drop(columns=[text_col]).assign(_r=pd.Series(answers, dtype=object, index=pdf.index),
                                                      _e=pd.Series(errors, dtype=object, index=pdf.index))

    kept = [f for f in rows.schema.fields if f.name != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _r string, _e string"
    return rows.mapInPandas(run, schema)


def _complete_batch(df: DataFrame, key: str, col: str, instruction: str, model: BatchModel, chunk_size: int) -> DataFrame:
    """M1 with a Python model: ``(key, col, <col>_error)`` with the joined answer.

    Keys must be unique.  Chunks are rows dealt by hash, so one very long text
    is answered by many tasks; a NULL text has no chunk rows but a marker row,
    so no second read of the texts is needed to tell it from an empty one.
    """
    error = f"{col}_error"
    rows = df.select(key, F.col(col).isNull().alias("_null"), F.posexplode_outer(TX.chunks(F.col(col), chunk_size)).alias("_i", "_c"))
    rows = rows.select(key, "_null", F.coalesce("_i", F.lit(-1)).alias("_i"), "_c").repartition(key, "_i")
    # rows without a chunk (NULL or empty texts) are not asked about
    asked = answer_rows(rows.where(F.col("_c").isNotNull()), "_c", instruction, model)
    rest = rows.where(F.col("_c").isNull()).select(key, "_null", "_i", F.lit(None).cast("string").alias("_r"), F.lit(None).cast("string").alias("_e"))
    answered = stable(asked.unionByName(rest))
    joined = answered.groupBy(key).agg(
        F.max("_null").alias("_null"), TX.ordered_join("_i", "_r").alias("_rs"), F.min("_e").alias(error))
    real = F.filter("_rs", lambda r: r.isNotNull())
    return joined.select(key, F.when(~F.col("_null") & F.col(error).isNull(), TX.join_responses(real)).alias(col), error)


def shorten_loop(df: DataFrame, col: str, size: int, first: str, again: str, model: ExprModel | BatchModel,
                 key: str = "id", passes: int = K.SHORTENING_PASSES, chunk_size: int = K.MAX_TOKENS // 2) -> DataFrame:
    """Answer ``col`` once, then re-answer while longer than ``size`` (at most
    ``passes`` more times).  Replaces ``col`` with the final answer.

    With an expression model each pass is one more projection (no shuffle);
    with a batch model each pass only sends the rows still too long, the loop
    stops as soon as none is, and ``<col>_error`` is added.
    """
    if isinstance(model, ExprModel):
        out = df.withColumn(col, complete_expr(F.col(col), first, model, chunk_size))
        for _ in range(passes):
            out = out.withColumn(col, F.when(F.length(col) > size, complete_expr(F.col(col), again, model, chunk_size))
                                 .otherwise(F.col(col)))
        return out
    cur = stable(_complete_batch(df.select(key, col), key, col, first, model, chunk_size))
    for _ in range(passes):
        long = cur.where(F.length(col) > size)
        if long.isEmpty():          # reads the checkpoint; nothing left to shorten
            break
        short = cur.where(~(F.length(col) > size) | F.col(col).isNull())
        cur = stable(short.unionByName(_complete_batch(long.select(key, col), key, col, again, model, chunk_size)))
    return df.drop(col).join(cur, key, "left").select(*df.columns, f"{col}_error")


def summarize(df: DataFrame, text_col: str, out_col: str = "summary",
              model: ExprModel | BatchModel | None = None, size: int = K.SUMMARY_SIZE,
              title_col: str | None = None, **kw) -> DataFrame:
    """M2: summary of the whole text (``title - text`` when ``title_col``)."""
    model = model or extract_model()
    src = TX.summary_input(F.col(title_col), F.col(text_col), True) if title_col else F.col(text_col)
    df2 = df.withColumn(out_col, src)
    return shorten_loop(df2, out_col, size, SUMMARY_INSTRUCTION, SHORTEN_INSTRUCTION, model, **kw)


def themes(df: DataFrame, text_col: str, out_col: str = "themes",
           model: ExprModel | BatchModel | None = None, size: int = K.THEMES_SIZE,
           title_col: str | None = None, **kw) -> DataFrame:
    """M3: themes of the whole text, re-listed while longer than ``size``."""
    model = model or terms_model()
    src = TX.summary_input(F.col(title_col), F.col(text_col), True) if title_col else F.col(text_col)
    df2 = df.withColumn(out_col, src)
    return shorten_loop(df2, out_col, size, THEMES_INSTRUCTION, SHORTEN_THEMES_INSTRUCTION, model, **kw)


def blurb(df: DataFrame, text_col: str, out_col: str = "blurb",
          model: ExprModel | BatchModel | None = None, **kw) -> DataFrame:
    """M4: a one-shot blurb (one pass, no shortening)."""
    model = model or short_model()
    return shorten_loop(df.withColumn(out_col, F.col(text_col)), out_col, 0, BLURB_INSTRUCTION,
                        BLURB_INSTRUCTION, model, passes=0, **kw)


def split_failures(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """K6 for models: (rows without an error, rows with one in ``problem``)."""
    error = f"{col}_error"
    if error not in df.columns:
        return df, df.limit(0).withColumn("problem", F.lit(None).cast("string"))
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull()).withColumnRenamed(error, "problem")
