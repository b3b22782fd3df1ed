"""Training-corpus pipeline: toxicity, quality rules, near-dedup, mixing, packing.

Each stage is written as Parquet and read again as the next one's documents.

Defined cases, by stage: null and empty texts get the toxicity score of texts
without segments, and fail the base quality rules; a row with a null doc_id is
linked with nothing and stays through near-dedup; rows that repeat an id stay or
go by their own texts, but share a verdict in mixing; a null source is a source
of its own; an empty table gives empty stages.  Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeleaf.llm import line_crf, mixing, near_dedup, packing, toxicity
from lakeleaf.llm.common import drop, scratch, table
from lakeleaf.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches 0.3; learns from the labels beside the tables."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or hold less content than boilerplate; learns from the labels beside the tables."""
    field = line_crf.fit_field(docs, table(spark, sf_dir, "labels"))
    return line_crf.with_quality(docs.select(*COLUMNS), field)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    gone = near_dedup.near_duplicates(docs, width=5, percent=80).filter("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix reads them, at most three times; those it does not reach go."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids by sequence."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), cache_bytes=64 << 20)


STAGES = [("toxicity", without_toxic), ("quality rules", with_quality), ("near-dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: Learned models, hashes and a tokenizer are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; a stage's rows are removed once the next stage has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        folder = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/rows")
        docs = spark.read.parquet(f"{folder}/rows")
        if before:
            drop(spark, before)
        before = folder
    return docs
