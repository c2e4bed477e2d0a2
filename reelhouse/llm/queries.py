"""The registered queries of the training-data operators, one an operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelhouse.llm import alignment, bpe, hmm, jaccard, ledger, mixing, pairwise, pii, prefix_trie, repetition, sketch, token_cache, warc
from reelhouse.llm.common import conversations, documents, labels, pages, shared_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def span_list(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s[kind], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str, value: str) -> Column:
    return F.size(F.filter(spans, lambda s: s[kind] == value)).cast("long")


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those not held out."""
    return hmm.language_model_scores(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a weighted mix of all sources takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).drop("n_servings")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts by a digest cache that starts empty."""
    counts = token_cache.token_counts(documents(spark, sf_dir), WORD_BPE, shared_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as captures, index them, and read them back through the index."""
    table, folder = pages(spark, sf_dir), shared_path(spark, "archives")
    index = warc.archive(table, folder)
    found = warc.read_records(warc.look_up(warc.keys_of(table), index), folder, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return repetition.repetition(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, then decode the ids."""
    found = bpe.round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        hex_digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[count_of(F.col("base"), "kind", k).alias(f"n_{k}") for k in pii.KINDS],
        hex_digest(span_list(F.col("base"), "kind")).alias("base_sha256"),
        span_list(F.col("spans"), "kind").alias("spans"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents by a ledger that starts empty."""
    found = ledger.scan_versions(documents(spark, sf_dir), shared_path(spark, "blob-ledger"))
    base = F.filter("findings", lambda f: f["rule"].isin(*ledger.BASE))
    return found.select(
        "doc_id", *[count_of(F.col("findings"), "rule", k).alias(f"n_{k}") for k in ledger.BASE],
        hex_digest(span_list(base, "rule")).alias("base_sha256"),
        span_list(F.col("findings"), "rule").alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit with the next one."""
    return sketch.compare_with_next(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document."""
    return alignment.align(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(conversations(spark, sf_dir))


def op13_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by preferences learnt from the labels that are not held out."""
    return pairwise.quality(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_hidden_markov, op2_mix_sources, op3_token_counts, op4_warc, op5_repetition, op6_byte_bpe, op7_personal_data, op8_jaccard_join, op9_secret_scans, op10_fingerprints,
    op11_alignment, op12_prefix_trie, op13_pairwise_quality)}

#: DuckDB SQL by query name, where SQL can express it.
SQL: dict[str, str] = {"op2_mix_sources": mixing.MIX_SQL, "op4_warc": warc.WARC_SQL,
                       "op12_prefix_trie": prefix_trie.TRIE_SQL}
