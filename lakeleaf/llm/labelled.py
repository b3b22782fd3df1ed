"""Bounded samples of labelled documents, for fitting models on the driver.

The bounds are parameters: rows of each class, and characters of a text that
may serve as an example.  Scoring never depends on them: it reads every text
whole.  The choice goes by crc32 of the id, so it is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_mod


def hash_sample(rows: DataFrame, n: int, total: int, salt: str, *ties: str) -> DataFrame:
    """Up to n rows, those with the smallest crc32 of id and salt.

    A threshold that leaves about twice as many comes first, so what the tasks send
    to the driver does not grow with their number.
    """
    key = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt)).cast("binary"))
    share = min(1.0, (2 * n + 50) / max(1, total))
    thinned = rows.withColumn("_key", key).filter(F.col("_key") < F.lit(int(share * 2**32)))
    return thinned.orderBy("_key", "doc_id", *ties).limit(n).drop("_key")


def labelled_sample(
    documents: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, rows_per_class: int, max_chars: int
) -> tuple[list[str], list[int], float]:
    """(texts, labels 0/1, share of label 1 among all training labels); rows whose crc32 modulo is ``held_out`` are never read.

    The ids of the sample are at most 2 * rows_per_class, which bounds the broadcast; of the
    texts that repeat an id one is taken, which bounds what comes to the driver.
    """
    usable = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_mod("doc_id", folds) != held_out))
    usable = usable.select("doc_id", F.col(target).cast("int").alias("label"))
    ones, total = usable.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    ones = ones or 0
    picked = None
    for label, n in ((0, total - ones), (1, ones)):
        part = hash_sample(usable.filter(F.col("label") == label), rows_per_class, n, "/sample")
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.select("doc_id", "text").filter(F.length("text").between(1, max_chars))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["text"], r["label"]))
    return [r["text"] for r in rows], [r["label"] for r in rows], ones / total if total else 0.5
