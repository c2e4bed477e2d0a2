"""Category vocabulary: configured list, stored categories, candidates,
membership test and bulk renames (S5, U1, A3, J2, K4, J5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions import fields as FF
from reelhouse.functions import text as TX
from reelhouse.operators.joins import stable


def configured_categories(spark: SparkSession, csv: str) -> DataFrame:
    """A comma-separated setting -> distinct stripped non-empty names."""
    one = spark.range(1).select(F.lit(csv).alias("csv"))
    names = one.select(F.explode(F.split("csv", ",")).alias("raw")) \
               .select(FF.strip("raw").alias("category"))
    return names.where(F.col("category") != "").distinct()


def stored_categories(library: DataFrame) -> DataFrame:
    """Distinct stored categories, hidden rows included (NULL excluded)."""
    return library.where(F.col("category").isNotNull()).select("category").distinct()


def candidate_vocabulary(configured: DataFrame, library: DataFrame) -> DataFrame:
    """Configured names plus stored ones other than "Uncategorized" (any case)."""
    stored = stored_categories(library).where(~F.col("category").ilike(K.UNCATEGORIZED))
    return configured.select("category").union(stored).distinct()


def vocabulary_text(vocab: DataFrame, sep: str = "\n") -> DataFrame:
    """A3: the sorted vocabulary as one string (what a prompt carries)."""
    return vocab.agg(F.array_join(F.array_sort(F.collect_set("category")), sep).alias("vocabulary"))


#: Characters of a pattern's literal run that serve as its join key.
RUN = 3


def plain_pattern(pattern: Column) -> Column:
    """An ILIKE pattern as the original database reads it: a backslash before
    an ordinary character stands for nothing; one at the end matches nothing
    (NULL)."""
    escaped = F.regexp_replace(pattern, r"(\\[%_\\])|\\", "$1")
    dangling = F.length(F.regexp_extract(pattern, r"(\\*)\z", 1)) % 2 == 1
    return F.when(~dangling, escaped)


def _literal_run(pattern: Column) -> Column:
    """The first ``RUN`` characters of the longest run without wildcards, lower-cased."""
    runs = F.transform(F.regexp_extract_all(pattern, F.lit(r"(?:\\.|[^%_\\])+"), F.lit(0)),
                       lambda r: F.regexp_replace(r, r"\\(.)", "$1"))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    return F.substring(F.lower(longest["run"]), 1, RUN)


def membership(answers: DataFrame, col: str, library: DataFrame) -> DataFrame:
    """``known`` = some stored category matches ``col`` as an ILIKE pattern.

    A pattern and a name can only match if the name holds the pattern's
    literal run, so the run's first characters are an equi key against the
    short substrings of the distinct names, and ILIKE verifies the candidates.
    A pattern of wildcards alone only asks for a name's length.
    """
    stored = stored_categories(library).select(F.lower("category").alias("_low")).distinct()
    pats = answers.select(F.col(col).alias("_raw")).where(F.col(col).isNotNull()).distinct().withColumn(
        "_pat", plain_pattern(F.col("_raw")))
    pats = stable(pats.where(F.col("_pat").isNotNull()).withColumn("_run", F.coalesce(_literal_run(F.col("_pat")), F.lit(""))))
    n = F.length("_low")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(RUN)), lambda k: F.substring("_low", i, k)))))
    keyed = stored.select("_low", F.explode(grams).alias("_run")).distinct()
    by_run = pats.where(F.col("_run") != "").join(keyed, "_run").where(F.expr("_low ILIKE _pat")).select("_raw")
    # wildcards only: '_' asks for one character each, '%' for any number more
    marks = pats.where(F.col("_run") == "").select(
        "_raw", F.length(F.regexp_replace("_pat", "%", "")).alias("_least"), F.col("_pat").contains("%").alias("_open"))
    lengths = stored.select(n.alias("_len")).distinct()
    exact = marks.where(~F.col("_open")).join(lengths, F.col("_least") == F.col("_len")).select("_raw")
    longest = lengths.agg(F.max("_len")).first()[0]
    longer = marks.where(F.col("_open") & (F.col("_least") <= F.lit(-1 if longest is None else longest))).select("_raw")
    known = by_run.union(exact).union(longer).distinct().withColumn("_known", F.lit(True))
    out = answers.join(known, answers[col] == known["_raw"], "left")
    return out.withColumn("known", F.coalesce("_known", F.lit(False))).drop("_raw", "_known")


def is_valid_answer(known: F.Column, answer: F.Column) -> F.Column:
    """F16: known, no double quote, at most three words."""
    return known & ~answer.contains('"') & (TX.word_count(answer) <= K.MAX_CATEGORY_WORDS)


def fold_renames(renames: list[tuple[str, str]]) -> dict[str, str]:
    """Final name of every renamed category after applying the renames in order.

    Each rename (old, new) moves everything currently named ``old`` to
    ``new``; an empty ``new`` is ignored.  The list is user input of bounded
    size, folded once on the driver.
    """
    steps = [(old, new) for old, new in renames if new]
    names = {old for old, _ in steps}
    final = {}
    for start in names:
        cur = start
        for old, new in steps:
            if cur == old:
                cur = new
        if cur != start:
            final[start] = cur
    return final


def rename_categories(library: DataFrame, renames: list[tuple[str, str]]) -> DataFrame:
    """Apply ordered renames (A->B then B->C moves A to C; onto an
    existing name merges) with one broadcast lookup join."""
    final = fold_renames(renames)
    if not final:
        return library
    spark = library.sparkSession
    mapping = spark.createDataFrame(sorted(final.items()), "old string, new string")
    joined = library.join(F.broadcast(mapping), library["category"] == mapping["old"], "left")
    return joined.withColumn("category", F.coalesce(mapping["new"], library["category"])) \
                 .select(*library.columns)
