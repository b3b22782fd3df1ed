"""Cut-offs, pins, filters and excerpts over ranked documents (qid, rank, score, heading, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U

DIGEST_CHARS = 200


def score_gap_select(ranking: DataFrame, floor: float = 0.35, gap: float = 0.4, late_gap: float = 0.5, late: int = 20, most: int = 100) -> DataFrame:
    """Keeps documents until the score falls off (O-127).

    Copies (equal first characters) are skipped but may stop the scan; the gap is
    to the last document kept before.
    """
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    copy = Window.partitionBy("qid", "_md5").orderBy(F.col("score").desc(), "rank")
    rows = ranking.withColumn("_md5", F.md5(F.substring("content", 1, DIGEST_CHARS).cast("binary"))).withColumn("_first", F.row_number().over(copy) == 1)
    rows = rows.withColumn("_kept", F.coalesce(F.sum(F.col("_first").cast("int")).over(earlier), F.lit(0)))
    rows = rows.withColumn("_prev", F.last(F.when(F.col("_first"), F.col("score")), ignorenulls=True).over(earlier)).withColumn("_top", F.first("score").over(order))
    drop = F.when(F.col("_kept") >= late, late_gap).otherwise(gap)
    stop = (F.col("_kept") >= 1) & ((F.col("score") < floor * F.col("_top")) | ((F.col("_prev") > 0) & (F.col("score") < F.col("_prev") * drop)))
    rows = rows.withColumn("_stop", F.max(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("_first") & (F.col("_stop") == 0) & (F.col("_kept") < most)).drop("_md5", "_first", "_kept", "_prev", "_top", "_stop")


def adaptive_cutoff(ranking: DataFrame, least: int = 3, most: int = 5, floor: float = 0.4, gap: float = 0.5) -> DataFrame:
    """After min(least, n) documents stops at a fall to floor * top or gap * previous; never more than ``most`` (O-128)."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank")
    rows = ranking.withColumn("_n", F.row_number().over(order)).withColumn("_top", F.first("score").over(order)).withColumn("_prev", F.lag("score").over(order))
    stop = (F.col("_n") > F.least(F.lit(least), F.count("*").over(Window.partitionBy("qid")))) & ((F.col("score") < floor * F.col("_top")) | ((F.col("_prev") > 0) & (F.col("score") < gap * F.col("_prev"))))
    rows = rows.withColumn("_here", stop.cast("int")).withColumn("_stop", F.max("_here").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("_stop") == 0) & (F.col("_n") <= most)).drop("_n", "_top", "_prev", "_here", "_stop")


def heading_matches(phrases: Column, heading: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(F.lower(heading), p))


def pin_headings(ranking: DataFrame, top: int = 30) -> DataFrame:
    """Documents whose heading has a phrase of the question come first, up to ``top``; the rest keep their order (O-129)."""
    rows = ranking.withColumn("_q", U.nfc(F.col("question"))).withColumn("_hit", heading_matches(T.phrases(F.col("_q")), F.col("heading"))).drop("_q")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("qid", "_hit").orderBy("rank"))).withColumn("_m", F.count_if("_hit").over(Window.partitionBy("qid")))
    rest = F.greatest(F.lit(0), F.lit(top) - F.col("_m"))
    bucket = F.when(F.col("_hit"), F.when(F.col("_nth") <= top, 0).otherwise(2)).otherwise(F.when(F.col("_nth") <= rest, 1).otherwise(3))
    pinned = rows.withColumn("_bucket", bucket).withColumn("pinned_rank", F.row_number().over(Window.partitionBy("qid").orderBy("_bucket", "rank")))
    return pinned.drop("_hit", "_nth", "_m", "_bucket")


def clear_winners(ranking: DataFrame, most: int = 3) -> DataFrame:
    """1 to ``most`` documents with a question phrase in the heading are the answer, with score 1 (O-130)."""
    hits = ranking.withColumn("_q", U.nfc(F.col("question"))).filter(heading_matches(T.phrases(F.col("_q")), F.col("heading"))).drop("_q")
    hits = hits.withColumn("_m", F.count("*").over(Window.partitionBy("qid"))).filter(F.col("_m") <= most)
    return hits.drop("_m").withColumn("rerank_score", F.lit(1.0))


def rerank(ranking: DataFrame, scorer, top: int = 30) -> DataFrame:
    """Clear winners, else the scorer's order of the first pinned documents with the adaptive cut-off (O-131).

    ``scorer(question, text)`` is a column function; a missing one leaves the lexical filter (O-133).
    """
    winners = clear_winners(ranking)
    if scorer is None:
        return lexical_filter(score_gap_select(ranking))
    rest = pin_headings(ranking.join(winners.select("qid").distinct(), "qid", "left_anti")).filter(F.col("pinned_rank") <= top)
    document = F.substring(F.concat_ws(" ", "heading", "content"), 1, 800)
    scored = rest.withColumn("rerank_score", scorer(F.col("question"), document)).withColumn("score", F.col("rerank_score")).drop("pinned_rank")
    return winners.unionByName(adaptive_cutoff(scored))


def lexical_filter(ranking: DataFrame, pattern: str = r"[\x{0B80}-\x{0BFF}]{2,}|[a-z0-9]{3,}") -> DataFrame:
    """Documents with enough of the question's terms, or one in the heading, by (phrase in heading, term in heading, terms, rank) (O-132)."""
    terms = F.array_distinct(F.filter(T.matches(F.lower("question"), pattern), lambda t: ~t.isin(*T.L.STOP_WORDS)))
    ordered = F.filter(T.matches(F.lower("question"), pattern), lambda t: ~t.isin(*T.L.STOP_WORDS))
    rows = ranking.withColumn("_terms", terms).withColumn("_ordered", ordered).withColumn("_text", F.lower(F.concat_ws(" ", "content", "heading")))
    rows = rows.withColumn("_words", F.array_distinct(T.matches(F.col("_text"), pattern))).withColumn("_heading", F.lower(F.coalesce("heading", F.lit(""))))
    hit = lambda t: F.contains(F.col("_text"), t) | F.exists("_words", lambda w: T.shares_prefix(w, t))
    bigrams = F.zip_with(F.slice("_ordered", F.lit(1), F.greatest(F.lit(0), F.size("_ordered") - 1)), F.slice("_ordered", F.lit(2), F.greatest(F.lit(0), F.size("_ordered") - 1)), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.withColumn("matched", F.size(F.filter("_terms", hit))).withColumn("bigram_hit", F.exists(bigrams, lambda g: F.contains(F.col("_heading"), g)))
    rows = rows.withColumn("heading_hit", F.exists("_terms", lambda t: F.contains(F.col("_heading"), t)) | F.col("bigram_hit"))
    need = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.size("_terms") * 0.3).cast("int")))
    kept = rows.filter((F.size("_terms") == 0) | (F.col("matched") >= need) | F.col("heading_hit"))
    order = Window.partitionBy("qid").orderBy(F.col("bigram_hit").desc(), F.col("heading_hit").desc(), F.col("matched").desc(), "rank")
    return kept.withColumn("filtered_rank", F.row_number().over(order)).drop("_terms", "_ordered", "_text", "_words", "_heading")


def key_facts(ranking: DataFrame, first: int = 15, limit: int = 20, least: int = 5, pattern: str = r"[\x{0B80}-\x{0BFF}]{3,}|[a-z]{4,}") -> DataFrame:
    """(qid, fact_rank, fact, score): sentences by 3 points per question keyword they contain (O-135)."""
    keywords = F.array_distinct(T.matches(F.lower("question"), pattern))
    rows = ranking.filter(F.col("rank") <= first).withColumn("_keywords", keywords)
    parts = rows.select("qid", "rank", "_keywords", F.posexplode(F.split("content", r"[.।!?]+")).alias("pos", "s")).withColumn("fact", T.strip(F.col("s"))).filter(F.length("fact") >= 30)
    scored = parts.withColumn("score", 3 * F.size(F.filter("_keywords", lambda k: F.contains(F.lower(F.col("fact")), k)))).filter(F.col("score") >= least)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank", "pos")
    return scored.withColumn("fact_rank", F.row_number().over(order)).filter(F.col("fact_rank") <= limit).select("qid", "fact_rank", "fact", "score")


def extractive_answer(facts: DataFrame, top: int = 5) -> DataFrame:
    """(qid, answer): the first facts, joined, with a closing mark (O-136)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_rank", "fact"))), lambda f: F.regexp_replace(f["fact"], r"__.*?__", "")), ". ")
    joined = facts.filter(F.col("fact_rank") <= top).groupBy("qid").agg(T.strip(body).alias("answer"))
    return joined.withColumn("answer", F.when(F.col("answer").rlike(r"[.!?।]$"), F.col("answer")).otherwise(F.concat("answer", F.lit("."))))


def contexts(ranking: DataFrame, first: int = 15, budget: int = 15_000, least: int = 500, pattern: str = r"[\x{0B80}-\x{0BFF}]{3,}|[a-z]{4,}") -> DataFrame:
    """(qid, context, documents): a first line, then numbered headers with the best excerpts, within a budget shared evenly (O-138)."""
    rows = ranking.filter(F.col("rank") <= first).withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).withColumn("_words", F.array_distinct(T.matches(F.lower("question"), pattern)))
    rows = rows.withColumn("_low", F.lower("content")).withColumn("_share", F.greatest(F.lit(least), F.floor(F.lit(budget) / F.col("_n")).cast("int")))
    excerpt = T.best_excerpt(F.col("content"), F.col("_words"), F.col("_share"), F.col("_low"))
    title = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" — "), F.col("heading"))).otherwise("")
    part = F.concat(F.lit("ஆவணம் "), F.col("_i"), F.lit("/"), F.col("_n"), title, F.lit(":\n"), F.coalesce(excerpt, F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i"), part.alias("part")))), lambda p: p["part"])
    head = F.concat(F.lit("["), F.first("_n"), F.lit(" ஆவணங்கள் — ஒவ்வொன்றின் தகவலையும் பயன்படுத்தவும்]\n"))
    return rows.groupBy("qid").agg(F.array_join(F.concat(F.array(head), parts), "\n\n").alias("context"), F.first("_n").alias("documents"))


def first_and_last(rows: DataFrame, order: list, ends: int = 10) -> DataFrame:
    """All of up to 2 * ends rows, else the first and last ends, with their absolute index (O-142)."""
    from ..functions.numbering import numbered

    out = numbered(rows, order, "index")
    n = rows.count()
    return out.filter((F.col("index") <= ends) | (F.col("index") > n - ends)) if n > 2 * ends else out
