"""Token counts through a digest cache (operator 3).

The cache is a Parquet folder of ``(content, n_tokens)``, one sub-folder for
each tokenizer version.  ``content`` is the SHA-256 of a text's normalised
content; the tokenizer's version is a digest of its file, the library's version
and the call's options.  A run joins the digests of its rows to the cache,
encodes each distinct missing content once, appends the counts, and joins all
rows to the cache again.

Only missing texts are shuffled (by digest, copies dropped first); everything
else moves digests: a run with few misses sends their digests to the texts.

The library is called for the distinct words of a block of texts rather than
for every text: the tokenizer's pattern has no match that holds ASCII white
space, normal forms do not compose across it and special strings hold none,
so a text's count is the sum over its runs of other characters.

Cases: a null text counts as the empty text (0 tokens); null ids and repeated
rows are kept, one result row each; an empty table gives an empty result; only
the two named columns are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse.llm import kernel
from reelhouse.llm.common import text_of, tidy, written
from reelhouse.llm.distinct import distinct_contents

#: Bytes of text whose distinct words are encoded together.
BLOCK = 4 << 20
#: Word counts a task remembers between blocks (then it starts anew).
REMEMBERED = 200_000
SCHEMA = "content binary, n_tokens bigint"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> tokenizers.Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def version(path: str) -> str:
    """Digest of all that decides a count: file, library version, options."""
    with open(path, "rb") as f:
        body = hashlib.sha256(f.read()).hexdigest()
    options = "add_special_tokens=False,truncation=None,padding=None,split=ascii-space"
    return hashlib.sha256(f"{body}:{tokenizers.__version__}:{options}".encode()).hexdigest()[:32]


def content(text: Column) -> Column:
    """Digest of the content; runs of ASCII white space count as one space."""
    plain = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        known: dict[int, int] = {}
        for batch in batches:
            for part in kernel.slices(batch, "_text", BLOCK):
                data, offsets = kernel.utf8(part.column(1))
                word, first, start, end = kernel.words_at(data, offsets)
                keys, example, inverse = np.unique(word, return_index=True, return_inverse=True)
                count = np.fromiter((known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
                new = np.flatnonzero(count < 0)
                for at in range(0, len(new), 5000):
                    some = new[at:at + 5000]
                    texts = [data[a:b].tobytes().decode() for a, b in zip(start[example[some]], end[example[some]])]
                    count[some] = [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
                if len(known) > REMEMBERED:
                    known.clear()
                known.update(zip(keys[new].tolist(), count[new].tolist()))
                sums = np.zeros(len(word) + 1, np.int64)
                np.cumsum(count[inverse], out=sums[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sums[first[1:]] - sums[first[:-1]])], ["content", "n_tokens"])
    return run


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, cache: str, tokenizer_version: str) -> DataFrame:
    """The cached counts of one tokenizer version, one row a content."""
    path = f"{cache}/tokenizer={tokenizer_version}"
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def missing(docs: DataFrame, cache: str, path: str, text_col: str = "text") -> DataFrame:
    """The distinct contents that the cache lacks, with a text for each."""
    rows = docs.select(content(text_of(text_col)).alias("content"), text_of(text_col).alias("_text"))
    spark, v = docs.sparkSession, version(path)
    if _exists(spark, f"{cache}/tokenizer={v}"):
        # digests only; texts then meet nothing but the digests that are missing
        todo = written(rows.select("content").distinct().join(stored(spark, cache, v), "content", "left_anti"), "missing")
        rows = rows.join(todo, "content", "left_semi")
    return distinct_contents(rows)


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of every row; ``cache`` gains what it lacked."""
    spark, v = docs.sparkSession, version(path)
    (missing(docs, cache, path, text_col).mapInArrow(tidy(_counts(path)), SCHEMA)
     .write.mode("append").parquet(f"{cache}/tokenizer={v}"))
    rows = docs.select(F.col(id_col), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
                       content(text_of(text_col)).alias("content"))
    # written: with a bare shuffle on either side Spark can split a content that very many rows hold
    return rows.join(written(stored(spark, cache, v), "counts").hint("merge"), "content").drop("content")
