"""Registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailloom.llm import (
    decontamination, hard_negatives, jaccard, multi_index, ngram_trie, packing, phrases, quality_classifier, quality_rules, secrets, substrings, warc, wavelet,
)
from mailloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_weak_labels(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


@query
def op2_hilbert_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op8_wavelet_tokens(spark, sf_dir):
    folder, manifest = wavelet.write_tokens(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return wavelet.read_tokens(folder, manifest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query
def op10_warc_salvage(spark, sf_dir):
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, manifest).filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_substring_automata(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query
def op4_positional_index(spark, sf_dir):
    found = decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query
def op6_secret_forest(spark, sf_dir):
    return secrets.findings(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "probability", "secret")


@query
def op7_elias_fano_lm(spark, sf_dir):
    return ngram_trie.score_texts(table(spark, sf_dir, "documents"))


@query
def op11_inverted_multi_index(spark, sf_dir):
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op12_son_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_threshold_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)
