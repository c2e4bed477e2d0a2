import hashlib
from collections import Counter

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from reelhouse.llm import bpe, token_cache
from reelhouse.llm.common import shared_path
from reelhouse.llm.queries import RANKS, WORD_BPE
from tests.llm.helpers import ODD, documents, random_texts

EXTRA = ["It's we'll DON'T 'sat", "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>", "é ́a\ń", "ﬁ Ǆ İ ΑΣ ς",
         "12345 !!?? 日本語テキスト", "a b c\x85d\x1fe", "tab\tnew\r\nline", "🙂🙃 👩‍👩‍👧", "\n" * 5000 + "x", " " * 9000]


def table(spark):
    texts = ODD + EXTRA + random_texts(20, 4) + ["a", "a"]
    return documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "null id", None), (1, "twice", "s")])


def test_counts_are_the_librarys(spark):
    tok = tokenizers.Tokenizer.from_file(WORD_BPE)
    tok.no_truncation()
    tok.no_padding()
    df = table(spark)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
                   for r in df.collect())
    cache = shared_path(spark, "test-cache")
    assert Counter(map(tuple, token_cache.token_counts(df, WORD_BPE, cache).collect())) == want


def test_only_distinct_misses_are_encoded_and_appended(spark):
    cache, version = shared_path(spark, "test-cache"), token_cache.version(WORD_BPE)
    first = documents(spark, [(1, "one two", "s"), (2, "one  two\n", "s"), (3, "three", "s")])
    assert token_cache.missing(first, cache, WORD_BPE).count() == 2
    token_cache.token_counts(first, WORD_BPE, cache).collect()
    assert token_cache.stored(spark, cache, version).count() == 2
    more = first.union(documents(spark, [(4, "four", "s"), (5, "four", "s")]))
    assert [r._text for r in token_cache.missing(more, cache, WORD_BPE).collect()] == ["four"]
    assert token_cache.token_counts(more, WORD_BPE, cache).count() == 5
    files = spark.read.schema(token_cache.SCHEMA).parquet(f"{cache}/tokenizer={version}")
    assert files.count() == 3
    # a second run reads what was stored, not a new count
    spark.createDataFrame([(hashlib.sha256(b"five").digest(), 55)], token_cache.SCHEMA).write.mode("append").parquet(
        f"{cache}/tokenizer={version}")
    got = token_cache.token_counts(documents(spark, [(9, "five", "s")]), WORD_BPE, cache).first()
    assert got.n_tokens == 55


def test_empty_table(spark):
    assert token_cache.token_counts(documents(spark, []), WORD_BPE, shared_path(spark, "test-cache")).collect() == []
    assert bpe.decode(bpe.encode(documents(spark, []), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect() == []


def test_encoding_is_the_librarys_and_decodes_back(spark):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    df = table(spark)
    ids = bpe.encode(df, RANKS, public_tokenizers.PATTERN, size=50)
    want = Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in df.collect())
    got = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want


def test_safe_pieces_change_nothing():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in [t for t in ODD + EXTRA + random_texts(40, 5) if t]:
        for size in (1, 3, 17):
            pieces = list(bpe.safe_pieces(text, size))
            assert "".join(pieces) == text
            assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [64])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1] == b"" and len(got[2]) == 1
    assert df.where(F.col("ids").isNull()).count() == 1


def test_round_trip_is_encode_then_decode(spark):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "a b", "s")])
    pattern = public_tokenizers.PATTERN
    two = bpe.decode(bpe.encode(docs, RANKS, pattern), RANKS, pattern)
    one = bpe.round_trip(docs, RANKS, pattern)
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
