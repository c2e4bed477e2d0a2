"""Categorisation by a model (M5 constrained, M6 free), with its prompts.

Prompts are Columns: the item, the candidate list and, on a retry, the answers
already turned down.  A round asks the model about the items still open (in
batches, failures kept as errors), cleans the answers and decides validity by
joins; the open items of the next round are those turned down.  A round's
answers are checkpointed, so a retried task never asks for a second answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions import text as TX
from reelhouse.operators.joins import stable
from reelhouse.operators.models import BatchModel, answer_rows
from reelhouse.operators.vocabulary import is_valid_answer, membership, vocabulary_text

CHOOSE_INSTRUCTION = "Input: an item and the allowed categories, one a line. Output: one of these lines, nothing else. "
NAME_INSTRUCTION = "Input: an item and known categories. Output: the best category, a known one if any fits, three words at most. "


def item_text(title: Column, summary: Column | None = None, themes: Column | None = None) -> Column:
    """The item's part of a prompt; parts that are NULL or empty are left out."""
    parts = [F.concat(F.lit("ITEM\n"), title)]
    for name, part in (("SUMMARY", summary), ("THEMES", themes)):
        if part is not None:
            parts.append(F.when(F.length(part) > 0, F.concat(F.lit(f"{name}\n"), part)))
    return F.concat_ws("\n\n", *parts)


def prompt(item: Column, candidates: Column, previous: Column | None = None) -> Column:
    """Item, candidate list and the section of answers turned down (if any)."""
    parts = [item, F.concat(F.lit("CATEGORIES\n"), candidates)]
    if previous is not None:
        parts.append(F.when(F.size(previous) > 0, F.concat(F.lit("PREVIOUS\n"), F.array_join(previous, "\n"))))
    return F.concat_ws("\n\n", *parts)


def categorize_by_model(items: DataFrame, key: str, item: Column, vocab: DataFrame, model: BatchModel,
                        out_col: str = "category") -> DataFrame:
    """M5: the candidate the model names (any case, NULL for another answer), and ``<out_col>_error``.

    Keys must be unique.
    """
    names = vocabulary_text(vocab).scalar()
    asked = items.select(key, prompt(item, names).alias("_p"))
    got = stable(answer_rows(asked, "_p", CHOOSE_INSTRUCTION, model))
    got = got.select(key, F.lower(TX.final_category(TX.clean_category("_r"))).alias("_low"), F.col("_e").alias(f"{out_col}_error"))
    known = vocab.groupBy(F.lower("category").alias("_low")).agg(F.min("category").alias(out_col))
    out = got.join(known, "_low", "left").select(key, out_col, f"{out_col}_error")
    return items.drop(out_col).join(out, key, "left")


def categorize_free_by_model(items: DataFrame, key: str, item: Column, vocab: DataFrame, library: DataFrame,
                             model: BatchModel, out_col: str = "category", retries: int = K.CATEGORY_RETRIES) -> DataFrame:
    """M6: a free category, asked again up to ``retries`` times, and ``<out_col>_error``.

    An answer is accepted when it is known (J2), has no double quote and at
    most three words.  One that is turned down is listed in the next prompt,
    unless it was too long.  The last answer is taken as it is, a too long one
    as "Uncategorized".  Keys must be unique.
    """
    names = vocabulary_text(vocab).scalar()
    open_ = items.select(key, item.alias("_item"), F.array().cast("array<string>").alias("_previous"))
    done = None
    for attempt in range(retries + 1):
        asked = open_.select(key, "_item", "_previous", prompt(F.col("_item"), names, F.col("_previous")).alias("_p"))
        got = answer_rows(asked, "_p", NAME_INSTRUCTION, model)
        got = stable(got.select(key, "_item", "_previous", TX.clean_category("_r").alias("_a"), "_e"))
        judged = membership(got, "_a", library).withColumns({
            "_ok": F.coalesce(is_valid_answer(F.col("known"), F.col("_a")), F.lit(False)) | F.col("_e").isNotNull(),
            "_long": F.coalesce(TX.word_count("_a") > K.MAX_CATEGORY_WORDS, F.lit(False))})
        last = attempt == retries
        answer = F.when(F.col("_long") & ~F.col("_ok"), F.lit(K.UNCATEGORIZED)).otherwise(TX.final_category("_a"))
        closed = judged.where(F.lit(last) | F.col("_ok")).select(key, answer.alias(out_col), F.col("_e").alias(f"{out_col}_error"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        open_ = stable(judged.where(~F.col("_ok")).select(key, "_item", F.when(F.col("_long"), F.col("_previous")).otherwise(
            F.array_append("_previous", F.col("_a"))).alias("_previous")))
        if open_.isEmpty():
            break
    return items.drop(out_col).join(done, key, "left")
