"""Ranking and answer metrics, pooling, relevance judgements and the permutation test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U

CUTS = (1, 3, 5, 10)


def ranking_metrics(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(system, qid, ndcg@k, recall@k, precision@k, hit@k, mrr, map) (O-220 to O-227).

    rankings are (system, qid, rank, doc_key), qrels (qid, doc_key, gain); queries
    (system, qid) may have empty rankings and then score 0.
    """
    own = Window.partitionBy("system", "qid").orderBy("rank")
    rows = rankings.join(qrels, ["qid", "doc_key"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    rows = rows.withColumn("hits", F.sum((F.col("gain") > 0).cast("int")).over(own))
    ideal = qrels.filter("gain > 0").withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("gain").desc(), "doc_key")))
    worth = lambda place: (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col(place) + 1.0)
    relevant = F.col("gain") > 0
    best = ideal.groupBy("qid").agg(F.count("*").alias("relevant"), *(F.sum(F.when(F.col("i") <= k, worth("i"))).alias(f"idcg{k}") for k in cuts))
    got = rows.groupBy("system", "qid").agg(
        F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.sum(F.when(relevant, F.col("hits") / F.col("rank"))).alias("ap"),
        *(F.count_if(relevant & (F.col("rank") <= k)).alias(f"n{k}") for k in cuts),
        *(F.sum(F.when(F.col("rank") <= k, worth("rank"))).alias(f"dcg{k}") for k in cuts),
    )
    full = queries.select("system", "qid").distinct().join(got, ["system", "qid"], "left").join(best, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = []
    for k in cuts:
        out += [
            zero(F.try_divide(F.col(f"dcg{k}"), F.col(f"idcg{k}"))).alias(f"ndcg@{k}"),
            zero(F.try_divide(F.col(f"n{k}"), F.col("relevant"))).alias(f"recall@{k}"),
            zero(F.col(f"n{k}") / k).alias(f"precision@{k}"),
            zero((F.col(f"n{k}") > 0).cast("double")).alias(f"hit@{k}"),
        ]
    return full.select("system", "qid", *out, zero(1 / F.col("first")).alias("mrr"), zero(F.try_divide(F.col("ap"), F.col("relevant"))).alias("map"))


def macro_average(metrics: DataFrame) -> DataFrame:
    """Mean of every metric per system (O-111)."""
    names = [c for c in metrics.columns if c not in ("system", "qid")]
    return metrics.groupBy("system").agg(F.count("*").alias("queries"), *(F.avg(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(c) for c in names))


def scorable(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with a positive gain (O-072)."""
    return queries.join(qrels.filter("gain > 0").select("qid").distinct(), "qid", "left_semi")


def round_robin_pool(rankings: DataFrame, systems: list[str], limit: int = 40) -> DataFrame:
    """(qid, doc_key, place): ranks of the systems interleaved, first seen kept (O-140)."""
    order = F.array_position(F.array(*map(F.lit, systems)), F.col("system"))
    seen = rankings.withColumn("_o", order).groupBy("qid", "doc_key").agg(F.min(F.struct("rank", "_o")).alias("at"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at", "doc_key"))
    return seen.withColumn("place", place).filter(F.col("place") <= limit).select("qid", "doc_key", "place")


def merged_judgements(reviews: DataFrame) -> DataFrame:
    """(qid, doc_key, gain): the human gain, else the model's, above 0; of rows for one key the last holds (O-115)."""
    gain = F.coalesce(F.expr("try_cast(nullif(trim(human_gain), '') as int)"), F.col("llm_gain").cast("int"))
    return reviews.withColumn("gain", gain).groupBy("qid", "doc_key").agg(F.max_by("gain", "row_no").alias("gain")).filter("gain > 0")


def parsed_grades(replies: DataFrame) -> DataFrame:
    """(qid, position, gain) from a judge's JSON: clamped to 0..3, bad JSON gives nothing (O-230)."""
    grades = F.from_json("reply", "array<struct<index:int,grade:int>>")
    rows = replies.select("qid", "pool_size", F.explode(grades).alias("g"))
    return rows.filter((F.col("g.index") >= 0) & (F.col("g.index") < F.col("pool_size"))).select("qid", F.col("g.index").alias("position"), F.least(F.lit(3), F.greatest(F.lit(0), F.col("g.grade"))).alias("gain"))


def answer_metrics(pairs: DataFrame, weights: tuple[float, float, float] = (0.70, 0.20, 0.10)) -> DataFrame:
    """Adds bleu_1, bleu_2, rouge_l and composite to (id, human, answer, similarity) (O-232 to O-237)."""
    human, answer = T.metric_text(U.nfc(F.col("human"))), T.metric_text(U.nfc(F.col("answer")))
    rows = pairs.withColumn("similarity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0)))))
    rows = rows.withColumn("bleu_1", U.bleu_1(human, answer)).withColumn("bleu_2", U.bleu_2(human, answer)).withColumn("rouge_l", U.rouge_l(human, answer))
    return rows.withColumn("composite", weights[0] * F.col("similarity") + weights[1] * F.col("rouge_l") + weights[2] * F.col("bleu_1"))


def permutation_p(differences: np.ndarray, draws: int = 10_000, seed: int = 12_345) -> float:
    """Two-sided sign-flip test with the (count + 1) / (draws + 1) estimate; empty or all-zero differences give 1."""
    d = np.asarray(differences, float)
    if not len(d) or not d.any():
        return 1.0
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(draws, len(d)))
    extreme = int((np.abs((signs * d).mean(axis=1)) >= abs(d.mean())).sum())
    return (extreme + 1) / (draws + 1)


def permutation_tests(metrics: DataFrame, metric: str, base: str) -> DataFrame:
    """(system, difference, p_value) of every other system against ``base``, paired by query (O-228).  One row a query reaches a task."""
    column = F.col(f"`{metric}`")
    own = metrics.filter(F.col("system") == base).select("qid", column.alias("b"))
    paired = metrics.filter(F.col("system") != base).select("system", "qid", column.alias("a")).join(own, "qid")

    def tested(pdf: pd.DataFrame) -> pd.DataFrame:
        d = (pdf.sort_values("qid")["b"] - pdf.sort_values("qid")["a"]).to_numpy()
        return pd.DataFrame({"system": [pdf["system"].iloc[0]], "difference": [d.mean()], "p_value": [permutation_p(d)]})

    return paired.groupBy("system").applyInPandas(tested, "system string, difference double, p_value double")



def ready(samples: DataFrame) -> DataFrame:
    """Samples with both answers (O-071)."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return samples.filter(filled("human_answer") & filled("llm_answer"))


def evaluated(samples: DataFrame, similarity) -> DataFrame:
    """Metrics of every ready sample with its question and category (O-083, O-238).

    ``similarity(human column, answer column)`` is the hook for unit vectors' cosine (O-232).
    """
    pairs = ready(samples).select("id", F.col("human_answer").alias("human"), F.col("llm_answer").alias("answer"))
    scored = answer_metrics(pairs.withColumn("similarity", similarity(F.col("human"), F.col("answer"))))
    return scored.drop("human", "answer").join(samples.select("id", "question", "category"), "id")


def report(samples: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: total, evaluated and skipped samples and the mean of every metric, 0 without any (O-112)."""
    names = ("similarity", "bleu_1", "bleu_2", "rouge_l", "composite")
    means = metrics.agg(F.count("*").alias("evaluated"), *(F.coalesce(F.avg(n), F.lit(0.0)).alias(f"avg_{n}") for n in names))
    total = samples.agg(F.count("*").alias("total"))
    return total.crossJoin(F.broadcast(means)).withColumn("skipped", F.col("total") - F.col("evaluated"))


def article_key(volume, issue, title):
    """'volume || issue || title', each trimmed (O-229)."""
    return F.concat_ws(" || ", *(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (volume, issue, title)))


def article_snippets(points: DataFrame, most: int = 900) -> DataFrame:
    """(doc_key, author, snippet) of article points: chunks by number, their first characters, the first author that is not empty (O-229)."""
    rows = points.filter(F.col("type") == "article").withColumn("doc_key", article_key("volume", "doc_issue", "title"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda c: c["content"]), " ")
    author = F.min_by("author", F.when(F.trim("author") != "", F.col("chunk_id")))
    return rows.groupBy("doc_key").agg(F.coalesce(author, F.lit("")).alias("author"), F.substring(body, 1, most).alias("snippet"))


def built_judgements(pool: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qrels, reviews) from a pool (qid, doc_key, place) and a judge's replies (qid, pool_size, reply): grades above 0, and rows for people (O-231)."""
    grades = parsed_grades(replies).select("qid", (F.col("position") + 1).alias("place"), F.col("gain").alias("llm_gain"))
    graded = pool.join(grades, ["qid", "place"], "left").withColumn("llm_gain", F.coalesce("llm_gain", F.lit(0)))
    reviews = graded.select("qid", "doc_key", "llm_gain", F.lit("").alias("human_gain"), F.col("place").alias("row_no"))
    return graded.filter("llm_gain > 0").select("qid", "doc_key", F.col("llm_gain").alias("gain")), reviews
