"""Gates and clean-up around an answer, and the texts and rows that are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U

# --- Fixed values: they must equal those of the semantics this engine implements. ---

SKIP_LINES = ("ஓரங்க நாடகம்", "தொடர் கதை", "சிறுவர் அரங்கம்", "பொங்கல் மலர்", "செய்திப்பாட்டு", "சிறுவர்", "அரங்கம்")
PAGE_MARKER = r"(?i)^-{2,}\s*Page\s+\d+.*-{2,}$"
#: A table row; a name, a dash and a word; 300 characters without a stop; repeated table rows.
GARBAGE_LINES = (
    r"[\x{0B80}-\x{0BFF}]+\s+\d\s+\d\s+\d",
    r"^[\x{0B80}-\x{0BFF}]+\s*—\s*[\x{0B80}-\x{0BFF}]",
    r"[^.?!।]{300,}",
    r"(?:[\x{0B80}-\x{0BFF}]+\s+[\x{0B80}-\x{0BFF}]+\s+\d\s+\d\s+\d\s*){2,}",
)

# --- Rules. ---

SOURCE_COLUMNS = ("volume", "heading", "doc_issue", "author_name", "content", "word_count", "chunks_merged", "score", "tags")


def is_skip_line(line: Column) -> Column:
    """A line that is a section name alone or a page marker (O-067)."""
    body = T.strip(line)
    return F.coalesce(body.isin(*SKIP_LINES) | body.rlike(PAGE_MARKER), F.lit(False))


def without_skip_lines(content: Column) -> Column:
    """The content without such lines, stripped (O-177)."""
    return T.strip(F.array_join(F.filter(F.split(content, "\n"), lambda x: ~is_skip_line(x)), "\n"))


def is_meaningful(question: Column) -> Column:
    """Any letter, digit, underscore or Tamil sign (O-069)."""
    return F.coalesce(question.rlike(r"[\p{L}\p{N}_\x{0B80}-\x{0BFF}]"), F.lit(False))


def garbage_at(answer: Column, least: int = 200, share: float = 0.3) -> Column:
    """Where an answer turns into raw records: the offset after its last good line; -1 if it does not (O-166).

    The first garbage line counts after which the good text exceeds the share; blank lines are neither.
    """
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("good"), F.lit(-1).alias("found"))

    def step(a: Column, line: Column) -> Column:
        bad, after = T.any_of(line, GARBAGE_LINES, ""), a["at"] + F.length(line) + 1
        good = F.when(~bad & (T.strip(line) != ""), after).otherwise(a["good"])
        found = F.when((a["found"] < 0) & bad & (a["good"] > share * F.length(answer)), a["good"]).otherwise(a["found"])
        return F.struct(after.alias("at"), good.alias("good"), found.alias("found"))

    folded = F.aggregate(F.split(answer, "\n"), none, step, lambda a: a["found"])
    return F.when(F.length(answer) >= least, folded).otherwise(F.lit(-1))


def without_garbage(answer: Column) -> Column:
    at = garbage_at(answer)
    return F.when(at >= 0, T.strip(F.substring(answer, F.lit(1), at))).otherwise(answer)


def relevant(ranking: DataFrame, stop_words: tuple[str, ...] = (), first: int = 10) -> DataFrame:
    """(qid, relevant) of rankings (qid, rank, question, content, heading, doc_issue, volume, author_name): could the evidence answer it? (O-170)

    Years of the question decide alone; else one Tamil or English term must occur, a
    Tamil one also by a common prefix; a question without terms is never refused.
    """
    terms = lambda c, p: F.array_except(F.array_distinct(T.matches(c, p)), F.array(*map(F.lit, stop_words or ("",))))
    rows = ranking.filter(F.col("rank") <= first)
    part = F.concat_ws(" ", "content", "heading", F.col("doc_issue").cast("string"), F.col("volume").cast("string"), "author_name")
    body = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), " "))
    per = rows.groupBy("qid").agg(F.first("question").alias("question"), body.alias("body"))
    per = per.withColumn("years", F.array_distinct(F.regexp_extract_all("question", F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(1))))
    per = per.withColumn("tamil", terms(F.col("question"), r"[\x{0B80}-\x{0BFF}]{2,}")).withColumn("english", terms(F.lower("question"), "[a-z]{3,}"))
    per = per.withColumn("words", F.array_distinct(T.matches(F.col("body"), r"[\x{0B80}-\x{0BFF}]{2,}")))
    has = lambda t: F.contains(F.col("body"), F.lower(t))
    found = F.exists("english", has) | F.exists("tamil", lambda t: has(t) | F.exists("words", lambda w: T.shares_prefix(w, t)))
    verdict = (
        F.when(F.size("years") > 0, F.exists("years", lambda y: F.contains(F.col("body"), y)))
        .when(F.size("tamil") + F.size("english") == 0, F.lit(True))
        .otherwise(found)
    )
    return per.select("qid", verdict.alias("relevant"))


def source_rows(merged: DataFrame) -> DataFrame:
    """The nine columns of evidence; a missing author is '', missing tags are none (O-064)."""
    empty = {"author_name": F.lit(""), "tags": F.expr("cast(array() as array<string>)")}
    named = {"heading": "title", "chunks_merged": "chunk_count"}

    def column(name: str) -> Column:
        held = name if name in merged.columns else named.get(name, name)
        if held in merged.columns:
            return (F.coalesce(held, empty[name]) if name in empty else F.col(held)).alias(name)
        return empty[name].alias(name)

    return merged.select("qid", *(column(c) for c in SOURCE_COLUMNS))


def answer_block(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, shown): the answer, then its numbered sources with header, word count and score (O-196)."""
    head = F.concat_ws(" • ", F.concat(F.lit("இதழ்: "), F.col("doc_issue")), F.concat(F.lit("மலர்: "), F.col("volume")), F.when(F.col("heading") != "", F.concat(F.lit("தலைப்பு: "), F.col("heading"))))
    figures = F.format_string("சொற்கள்: %d | பொருத்தம்: %.3f", F.col("word_count").cast("long"), F.col("score").cast("double"))
    numbered = sources.withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "heading")))
    part = F.concat_ws("\n", F.concat(F.lit("ஆதாரம் "), F.col("_i")), head, figures, F.lit(""), "content", F.lit(""))
    per = numbered.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", part.alias("p")))), lambda x: x["p"]).alias("_parts"))
    listed = F.concat(F.array(F.concat(F.lit("\nஆதாரங்கள் ("), F.size("_parts"), F.lit(" ஆவணங்கள்):")), F.lit("")), F.col("_parts"))
    own = F.array(F.lit("பதில்:"), F.col("answer"), F.lit(""))
    shown = F.array_join(F.when(F.size("_parts") > 0, F.concat(own, listed)).otherwise(own), "\n")
    return answers.join(per, "qid", "left").select("qid", shown.alias("shown"))


def listed_articles(articles: DataFrame, key: str, order: list) -> DataFrame:
    """(key, listing): numbered lines of title, author and, where known, year and issue, in the order (O-196)."""
    named = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label + ": "), F.col(c).cast("string")))
    line = F.concat_ws(" | ", F.concat(F.lit("தலைப்பு: "), F.coalesce("title", F.lit("-"))), F.concat(F.lit("ஆசிரியர்: "), F.coalesce("author", F.lit("-"))), named("ஆண்டு", "year"), named("இதழ்", "issue"))
    rows = articles.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    parts = F.array_sort(F.collect_list(F.struct("_i", F.concat(F.col("_i"), F.lit(". "), line).alias("p"))))
    return rows.groupBy(key).agg(F.count("*").alias("articles"), F.array_join(F.transform(parts, lambda x: x["p"]), "\n").alias("listing"))


def cache_key(question: Column) -> Column:
    """SHA-256 of the NFC, lower-case question with collapsed blanks (O-180)."""
    return F.sha2(F.lower(F.regexp_replace(T.strip(U.nfc(question)), r"(?U)\s+", " ")), 256)
