"""Correction of whole questions in passes over several vocabularies (O-190)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch
from .catalog import corrections

TAMIL = r"[\x{0B80}-\x{0BFF}]+"
GRAM = 4


def grams(c: Column) -> Column:
    """Distinct runs of GRAM characters of a text that has at least so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(c, i, GRAM)))


def contained(words: DataFrame, runs: DataFrame) -> DataFrame:
    """The distinct words (word) of GRAM characters or more that are part of some run (run), in lower case.

    Runs are posted under their grams.  A word is looked up under its rarest gram only; one with a gram
    that no run has drops out before any run is compared.
    """
    posted = runs.select(F.lower("run").alias("run")).distinct().filter(F.length("run") >= GRAM).select("run", F.explode(grams(F.col("run"))).alias("gram"))
    asked = words.select("word", F.lower("word").alias("low")).distinct()
    asked = asked.select("word", "low", F.explode(grams(F.col("low"))).alias("gram"), F.size(grams(F.col("low"))).alias("wanted"))
    known = asked.join(posted.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    rarest = known.groupBy("word", "low", "wanted").agg(F.min(F.struct("n", "gram")).alias("least"), F.count("*").alias("found")).filter("found = wanted")
    placed = rarest.select("word", "low", F.col("least.gram").alias("gram"))
    return placed.join(posted, "gram").filter(F.contains("run", "low")).select("word").distinct()


def replaced(questions: DataFrame, fixes: DataFrame) -> DataFrame:
    """Adds ``after``: the question with every (question, position, token, word) replaced in order, each at the token's first place left."""
    listed = fixes.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("position", "token", "word"))).alias("_fixes"))

    def once(text: Column, fix: Column) -> Column:
        at = F.instr(text, fix["token"])
        put = F.concat(F.substring(text, F.lit(1), at - 1), fix["word"], F.substring(text, at + F.length(fix["token"]), F.length(text)))
        return F.when(at > 0, put).otherwise(text)

    after = F.when(F.col("_fixes").isNull(), F.col("question")).otherwise(F.aggregate("_fixes", F.col("question"), once))
    return questions.join(listed, "question", "left").withColumn("after", after).drop("_fixes")


def corrected_questions(
    questions: DataFrame,
    known: DataFrame,
    titles: DataFrame,
    authors: DataFrame,
    headings: DataFrame,
    pattern: str = TAMIL,
    least: float = 0.88,
) -> DataFrame:
    """(question, corrected) of every distinct text of ``question``; the vocabularies hold a column ``text``.

    First the words of ``known`` correct a question, then, in what that gives, the words of titles, headings
    and author names.  Tokens of fewer than four characters and known ones stay, in the second pass also
    those that a title or heading contains, with or without a possessive.  A correction needs a similarity of
    ``least`` and the guard of ``safe_to_correct``; of several words the most similar safe one is taken, then the
    smallest, so a more similar word that is not safe does not forbid it.  A null question stays null, an empty
    one empty; null vocabulary rows count for nothing.  ``pattern`` must be a repeated class of characters.
    """
    words = lambda rows: rows.select(F.explode(T.matches(F.col("text"), pattern)).alias("word")).distinct()
    sure = words(known)
    asked = questions.select("question").distinct()

    def tokens(rows: DataFrame, column: str) -> DataFrame:
        found = rows.select(F.col(column).alias("question"), F.posexplode(T.matches(F.col(column), pattern)).alias("position", "token"))
        return found.filter(F.length("token") >= 4)

    def fixes(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
        best = corrections(rows.select(F.col("asked").alias("token")), vocabulary, least)
        return rows.join(best.select(F.col("token").alias("asked"), "word"), "asked").select("question", "position", "token", "word")

    first = tokens(asked, "question").withColumn("asked", F.col("token"))
    unknown = first.join(sure, F.col("token") == F.col("word"), "left_anti")
    # Written once, as the second pass reads it several times; the folder goes when the driver's JVM ends.
    path = scratch(questions.sparkSession, "questions") + "/rows"
    replaced(asked, fixes(unknown, sure.filter(F.length("word") >= 4))).write.parquet(path)
    once = questions.sparkSession.read.schema("question string, after string").parquet(path)

    later = tokens(once, "after").distinct().withColumn("asked", T.without_possessive(F.col("token")))
    both = later.select(F.explode(F.array("token", "asked")).alias("word")).distinct()
    texts = words(titles.select("text").unionByName(headings.select("text")))
    settled = sure.union(contained(both.filter(F.length("word") >= GRAM), texts.select(F.col("word").alias("run")))).distinct()
    unsettled = later.join(settled, (F.col("token") == F.col("word")), "left_anti").join(settled, F.col("asked") == F.col("word"), "left_anti")
    vocabulary = texts.union(words(authors)).distinct().filter(F.length("word") >= 4)
    again = replaced(once.select(F.col("after").alias("question")).distinct(), fixes(unsettled, vocabulary))
    last = again.select(F.col("question").alias("after"), F.col("after").alias("corrected"))
    same = once["after"].eqNullSafe(last["after"])
    return once.join(last, same).select("question", "corrected")
