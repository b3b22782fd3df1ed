"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, group_join, line_crf, mixing, near_dedup, packing, periodic, simhash, token_counts, toxicity, turns, url_trust, warc
from .common import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's vocabulary, installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.filter_urls(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(token_counts.VOCABULARY))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = line_crf.apply_rules(docs, line_crf.fit_field(docs, table(spark, sf_dir, "labels")))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digests(turns.reassemble(turns.scheduled(table(spark, sf_dir, "conversations"))))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.with_repeats(table(spark, sf_dir, "documents"))))


def op13_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.join_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_trust, op2_warc, op3_token_counts, op4_byte_cnn, op5_line_crf, op6_minmax_dedup,
        op7_simhash, op8_toxic_segments, op9_harmonic_packing, op10_mix, op11_turns, op12_runs, op13_group_join,
    )
}

ORACLE_SQL = {
    "op1_url_trust": url_trust.filter_urls_sql(),
    "op2_warc": warc.archive_round_trip_sql(),
    "op6_minmax_dedup": near_dedup.near_duplicates_sql(),
    "op10_mix": mixing.mix_sql(),
    "op13_group_join": group_join.join_documents_sql(),
    "op11_turns": turns.reassembly_sql(),
}
