"""Catalogue queries: facets, counts, listings and the staged topic lookup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import udfs as U
from ..functions.similar import likely, ratio_bound
from ..session import checkpoint
from .understanding import TITLE_SUFFIXES

def clean(catalog: DataFrame) -> DataFrame:
    """Author cells trimmed, rows without an author dropped, titles trimmed (O-010)."""
    rows = catalog.withColumn("author", F.trim(F.coalesce("author", F.lit("")))).filter(F.col("author") != "")
    return rows.withColumn("title", F.trim("title"))


def renamed(catalog: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Renames an alias only where its target is absent (O-011)."""
    for old, new in aliases.items():
        if old in catalog.columns and new not in catalog.columns:
            catalog = catalog.withColumnRenamed(old, new)
    return catalog


def author_counts(catalog: DataFrame) -> DataFrame:
    """(author, articles), most first, ties by name (O-100)."""
    return catalog.select(F.explode(T.authors_of(F.col("author"))).alias("author")).groupBy("author").agg(F.count("*").alias("articles")).orderBy(F.col("articles").desc(), "author")


def issue_counts(catalog: DataFrame) -> DataFrame:
    """(issue, articles) of non-empty issues (O-101)."""
    return catalog.select(F.trim(F.col("issue").cast("string")).alias("issue")).filter("issue <> ''").groupBy("issue").agg(F.count("*").alias("articles"))


def issue_stats(counts: DataFrame) -> DataFrame:
    """Issues, articles, and mean to one place, least and most per issue (O-102)."""
    return counts.agg(F.count("*").alias("issues"), F.coalesce(F.sum("articles"), F.lit(0)).alias("articles"), F.round(F.avg("articles"), 1).alias("mean"), F.min("articles").alias("least"), F.max("articles").alias("most"))


def issue_order(issues: DataFrame) -> DataFrame:
    """Adds sort_key: numeric if every issue is a number, else the text (Q5)."""
    plain = issues.agg(F.coalesce(F.bool_and(F.col("issue").rlike(r"^\d+$")), F.lit(True)).alias("all_numbers"))
    return issues.crossJoin(F.broadcast(plain)).withColumn("sort_key", F.when(F.col("all_numbers"), F.lpad("issue", 20, "0")).otherwise(F.col("issue"))).drop("all_numbers")


def start_year(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.min(F.expr("try_cast(year as int)")).alias("start_year"))


def tag_counts(points: DataFrame) -> DataFrame:
    """Every category with its number of articles (chunk 0), most first (O-091, O-104)."""
    spark = points.sparkSession
    names = spark.createDataFrame([(i, tag, *both) for i, (tag, both) in enumerate(L.TAXONOMY.items())], "position int, tag string, tamil string, english string")
    counts = points.filter(F.col("chunk_id") == 0).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("articles"))
    return names.join(counts, "tag", "left").select("tag", "tamil", "english", F.coalesce("articles", F.lit(0)).alias("articles"), "position").orderBy(F.col("articles").desc(), "position").drop("position")


def volume_summary(issues: DataFrame) -> DataFrame:
    """(volume, issues, years) with years as one year or first-last (O-105)."""
    rows = issues.groupBy("volume").agg(F.count("*").alias("issues"), F.min("year").alias("a"), F.max("year").alias("b"), F.count_distinct("year").alias("n"))
    return rows.select("volume", "issues", F.when(F.col("n") > 1, F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.col("a").cast("string")).alias("years"))


def registry_issues(registry: DataFrame) -> DataFrame:
    """One row per issue; an issue without a year takes its volume's (O-090)."""
    rows = registry.select(F.explode("volumes").alias("v")).select(F.col("v.id").alias("volume"), F.col("v.year").alias("volume_year"), F.explode("v.issues").alias("i"))
    return rows.select("volume", F.col("i.num").cast("string").alias("issue"), F.coalesce("i.year", "volume_year").alias("year"), "i.pdf_url")


def browse(points: DataFrame, category: str | None = None, search: str | None = None) -> DataFrame:
    """Chunk-0 articles of a category whose title, an author or a tag name has the search text (O-053, O-059), one per article key."""
    rows = points.filter(F.col("chunk_id") == 0)
    if category:
        if category not in L.TAXONOMY:
            raise ValueError(f"unknown category {category}")
        rows = rows.filter(F.array_contains("tags", category))
    if search:
        low = search.lower()
        has = lambda c: F.contains(F.lower(c), F.lit(low))
        names = F.create_map(*(F.lit(x) for tag, (tamil, _) in L.TAXONOMY.items() for x in (tag, tamil)))
        rows = rows.filter(has(F.col("title")) | F.exists("authors", has) | F.exists("tags", lambda t: has(F.coalesce(names[t], t))))
    key = Window.partitionBy("doc_id", "doc_issue", "article_no").orderBy("title")
    return rows.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n")


def browse_stats(articles: DataFrame) -> DataFrame:
    """Distinct authors and tags (O-109)."""
    authors = articles.select(F.explode("authors").alias("a")).agg(F.count_distinct("a").alias("authors"))
    tags = articles.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("tags"))
    return authors.crossJoin(F.broadcast(tags))


def issue_articles(points: DataFrame, doc_id: str, issue: str) -> DataFrame:
    """Chunk-0 articles of an issue, festival issues folded together (O-055, O-056)."""
    same = T.folded_issue(F.col("doc_issue").cast("string")) == T.folded_issue(F.lit(issue))
    return points.filter((F.col("chunk_id") == 0) & (F.col("doc_id").cast("string") == str(doc_id)) & same)


def article_content(points: DataFrame) -> DataFrame:
    """(doc_id, doc_issue, article_no, title, content, word_count, chunks): chunks by line, details of the first (O-107)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda c: c["content"]), "\n")
    rows = points.groupBy("doc_id", "doc_issue", "article_no").agg(F.min_by("title", "chunk_id").alias("title"), body.alias("content"), F.count("*").alias("chunks"))
    return rows.withColumn("word_count", F.size(F.filter(F.split("content", r"(?U)\s+"), lambda w: w != "")))


def with_tags(catalog: DataFrame, tagged: DataFrame) -> DataFrame:
    """Tags of the article, else of its issue's first article, else '' (O-081)."""
    exact = tagged.select("doc_id", "doc_issue", "article_no", F.array_join("tags", ", ").alias("_own"))
    first = tagged.groupBy("doc_id", "doc_issue").agg(F.min_by(F.array_join("tags", ", "), "article_no").alias("_issue"))
    rows = catalog.join(exact, ["doc_id", "doc_issue", "article_no"], "left").join(first, ["doc_id", "doc_issue"], "left")
    return rows.withColumn("tag_text", F.coalesce(F.nullif("_own", F.lit("")), "_issue", F.lit(""))).drop("_own", "_issue")


def author_matches(search: str, cell: Column) -> Column:
    """Flexible author match (O-150): equal, part, alias, tokens, ratio 0.95, one edit."""
    want = T.author_key(F.lit(U.nfc_text(search)))
    def one(name: Column) -> Column:
        have = T.author_key(name)
        shorter, longer = F.when(F.length(want) <= F.length(have), want).otherwise(have), F.when(F.length(want) <= F.length(have), have).otherwise(want)
        at = F.position(shorter, longer)
        extra = F.concat(F.substring(longer, F.lit(1), at - 1), F.substring(longer, at + F.length(shorter), F.length(longer)))  # the first place only
        part = F.contains(longer, shorter) & ~extra.rlike("[a-zA-Z]")
        alias = F.lit(False)
        for key, others in L.ALIASES.items():
            for o in others:
                alias = alias | (F.contains(want, F.lit(key)) & F.contains(have, F.lit(o))) | (F.contains(have, F.lit(key)) & F.contains(want, F.lit(o)))
        mixed = r"[\x{0B80}-\x{0BFF}][a-zA-Z]|[a-zA-Z][\x{0B80}-\x{0BFF}]"
        long = lambda c: F.filter(T.matches(c, r"[\x{0B80}-\x{0BFF}]+"), lambda t: F.length(t) >= 4)
        tokens = ~want.rlike(mixed) & ~have.rlike(mixed) & (F.size(long(want)) > 0) & F.forall(long(want), lambda t: F.array_contains(long(have), t))
        return (have != "") & ((want == have) | part | alias | tokens | T.within_one_edit(want, have))

    # The similarity UDF cannot run inside a lambda, so it takes the cell's array and compares name by name;
    # names whose lengths rule the ratio out are not handed over.
    names = T.authors_of(U.nfc_all(cell))
    fits = lambda k: 2 * F.least(F.length(want), F.length(k)) >= 0.95 * (F.length(want) + F.length(k)) - 1e-9
    keys = F.filter(F.transform(names, T.author_key), lambda k: fits(k) | ~k.rlike(r"^[\x00-\x7F]*$"))
    alike = U.best_ratio(want, F.coalesce(keys, F.array().cast("array<string>"))) >= 0.95
    return (want != "") & (F.exists(names, one) | alike)


def articles_of_author(catalog: DataFrame, name: str) -> DataFrame:
    """Articles of an author by year (unknown last) and issue (O-086, O-141)."""
    return catalog.filter(author_matches(name, F.col("author"))).orderBy(F.coalesce(F.expr("try_cast(year as int)"), F.lit(9999)), F.col("issue").cast("string"), "title")


#: Names of the highest bounds that are compared first.
NEAREST_FIRST = 32


def nearest(names: DataFrame, column: str, text: str, least: float = 0.70, reads: dict | None = None) -> DataFrame:
    """The most similar name, at least ``least`` alike; ties go to the first in order (O-139).

    The names of the highest bounds give a ratio that the best one must reach, and only
    names whose bound does so are compared.  ``reads`` takes the numbers of names, and of names compared.
    """
    bounded = checkpoint(names.select(F.col(column).alias("name")).distinct().withColumn("bound", ratio_bound(text, U.folded(F.col("name")))))
    alike = lambda rows: rows.withColumn("ratio", U.ratio(F.lit(text), F.col("name")))
    first = alike(bounded.orderBy(F.col("bound").desc(), "name").limit(NEAREST_FIRST)).agg(F.max("ratio")).first()[0] or 0.0
    some = bounded.filter(F.col("bound") >= max(first, least))
    if reads is not None:
        reads |= {"names": bounded.count(), "compared": some.count() + NEAREST_FIRST}
    return alike(some).filter(F.col("ratio") >= least).select("name", "ratio").orderBy(F.col("ratio").desc(), "name").limit(1)


def issue_contents(catalog: DataFrame, volume: int, issue: int) -> DataFrame:
    """Rows whose volume and issue are these numbers (O-058, O-194)."""
    return catalog.filter((F.expr("try_cast(volume as double)") == volume) & (F.expr("try_cast(issue as double)") == issue))


def topic_text(topic: str, suffixes: tuple[str, ...] = TITLE_SUFFIXES) -> str:
    """A topic without content-type words at its end, possessives, quotes and question marks (O-145a)."""
    out = topic
    for s in suffixes:
        out = re.sub(rf"\s*{re.escape(s)}\s*$", "", out.strip(), flags=re.IGNORECASE)
    return re.sub("['\"?]", "", without_possessive(out)).strip()


def without_possessive(text: str) -> str:
    """``text.without_possessive`` of one string on the driver."""
    for suffix, by in L.POSSESSIVES:
        text = re.sub(rf"{suffix}(?=\s|$)", by, text)
    for suffix in L.POSSESSIVES_AFTER_TAMIL:
        text = re.sub(rf"([\u0B80-\u0BFF]){suffix}(?=\s|$)", r"\1", text)
    return text


def by_topic(catalog: DataFrame, topic: str) -> DataFrame:
    """The first of the stages that finds something for a topic (O-145): adds stage and ratio.

    The stages without similarity are counted in one pass over the catalogue, a stage over its row guard
    counts as empty; similarity is computed only for the rows of the stage that answers, or that
    can reach stage 4.
    """
    q = topic_text(topic).lower()
    words = q.split()
    runs = re.findall("[\u0B80-\u0BFF]+", q)
    title = F.lower(F.col("title"))
    contains = lambda w: F.contains(title, F.lit(w))
    everything = lambda ws: F.lit(bool(ws)) & _all([contains(w) for w in ws])
    tokens = T.matches(title, r"[\x{0B80}-\x{0BFF}]+|[a-zA-Z]+")
    some = [w for w in words if len(w) >= 3]
    hits = sum((F.array_contains(tokens, w).cast("int") for w in some), F.lit(0))
    stages: list[tuple[str, Column, int | None]] = [
        ("1", F.lit(bool(q)) & contains(q), None),
        ("2", F.lit(len(words) >= 2) & everything(words), None),
        ("2b", F.lit(len(words) > 2 and len(some) >= 2) & (hits >= max(2, int(0.6 * len(some)))), 8),
    ]
    longest = max((w for w in words if re.search("[\u0B80-\u0BFF]{6,}", w)), key=len, default=None)
    stages.append(("3", contains(longest) if longest else F.lit(False), 10))
    base = max((w for w in runs if len(w) >= 5), key=len, default="")
    stages += [(f"3b{i:03}", contains(base[:i] + base[i + 1 :]), 8) for i in range(len(base))]
    long = [w for w in words if len(w) >= 5]
    after: list[tuple[str, Column, int | None]] = [
        ("5", everything(long) if len(long) >= 2 else F.lit(False), None),
        ("5s", contains(long[0]) if len(long) == 1 and len(long[0]) >= 7 else F.lit(False), 5),
    ]
    counts = catalog.agg(*(F.count_if(p).alias(f"c{i}") for i, (_, p, _) in enumerate(stages + after))).first()
    found = [i for i, (_, _, guard) in enumerate(stages + after) if counts[f"c{i}"] and (guard is None or counts[f"c{i}"] <= guard)]
    # Similarity runs where a stage has found rows already; for stage 4 itself, where characters allow it.
    asked = [w for w in runs if len(w) >= 4]
    tokens_of_title = F.filter(T.matches(F.col("title"), r"[\x{0B80}-\x{0BFF}]+"), lambda t: F.length(t) >= 4)

    def alike(rows: DataFrame) -> DataFrame:
        by_token = 0.95 * U.least_best_ratio(F.array(*map(F.lit, asked)), tokens_of_title) if asked else F.lit(0.0)
        rows = rows.withColumn("_whole", U.ratio(F.lit(q), F.col("title"))).withColumn("_token", by_token)
        return rows.withColumn("ratio", F.when(F.col("_whole") >= 0.72, F.col("_whole")).when(F.col("_token") >= 0.95 * 0.79 - 1e-12, F.col("_token")).otherwise(F.col("_whole")))

    def stage(rows: DataFrame, name: str) -> DataFrame:
        return rows.drop("_whole", "_token").withColumn("stage", F.lit(name[:2])).orderBy(F.col("ratio").desc(), "title")

    if found and found[0] < len(stages):
        name, passes, _ = stages[found[0]]
        return stage(alike(catalog.filter(passes)), name)
    can = likely(q, U.folded(F.col("title")), 0.72)
    if asked:
        can = can | (F.size(tokens_of_title) > 0)  # Tamil tokens are compared as they are
    fourth = checkpoint(alike(catalog.filter(can)).filter((F.col("_whole") >= 0.72) | (F.col("_token") >= 0.95 * 0.79 - 1e-12)))
    if not fourth.isEmpty():
        return stage(fourth, "4")
    if found:
        name, passes, _ = after[found[0] - len(stages)]
        return stage(alike(catalog.filter(passes)), name)
    return alike(catalog.filter("false")).drop("_whole", "_token").withColumn("stage", F.lit(None).cast("string"))


def suggestion(catalog: DataFrame, topic: str, least: float = 0.70) -> DataFrame:
    """The most similar title for a topic that finds nothing (O-145i)."""
    return nearest(catalog, "title", topic_text(topic), least)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def vocabulary(texts: DataFrame, column: str, pattern: str = r"[\x{0B80}-\x{0BFF}]{4,}") -> DataFrame:
    """Distinct words (O-110)."""
    return texts.select(F.explode(T.matches(F.lower(column), pattern)).alias("word")).distinct()


def alike(tokens: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(token, word), maybe repeated: all pairs that the guard allows and whose ratio can reach ``least``, and few others.

    With three equal leading characters and lengths that differ by 2 at most, such a pair differs by k single deletions and
    insertions at most.  Of k + 1 parts of the token's rest one is then whole in the word's, at most k places away, so
    the pair meets under it.  Texts that folding to NFC or lower case may shift meet under their first characters alone.
    """
    edits = lambda n: F.least(F.floor((1 - least) * (2 * n + 2) + 1e-9).cast("int"), n - 3)
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.expr("cast(array() as array<int>)"))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        head, low = F.substring(name, 1, 3), U.folded(F.col(name))
        rows = rows.select(name, head.alias("_head"), low.alias("_low"), F.substring(low, 4, 1 << 30).alias("_rest"), F.length(name).alias("_n"))
        plain = (F.length("_low") == F.col("_n")) & (F.lower(name) == F.col("_low")) & (F.lower("_head") == F.substring("_low", 1, 3))
        return rows.filter(F.col("_n") >= 3).withColumn("_plain", plain)

    def start(n: Column, i: Column) -> Column:
        return F.floor(i * (n - 3) / (edits(n) + 1)).cast("int")

    def key(n: Column, i: Column, at: Column) -> Column:
        return F.concat_ws("|", F.lit("part"), "_head", n.cast("string"), i.cast("string"), F.substring(F.col("_rest"), at + 1, start(n, i + 1) - start(n, i)))

    def shifted(n: Column, i: Column) -> Column:
        first, k = start(n, i), edits(n)
        return F.transform(upto(F.greatest(F.lit(0), first - k), F.least(first + k, F.col("_n") - 3 - start(n, i + 1) + first)), lambda at: key(n, i, at))

    whole = lambda kind: F.concat_ws("|", F.lit(kind), "_head")
    own = F.concat(F.transform(upto(F.lit(0), edits(F.col("_n"))), lambda i: key(F.col("_n"), i, start(F.col("_n"), i))), F.array(whole("shifting")))
    asked = keyed(tokens, "token").select("token", F.explode(F.when(F.col("_plain"), own).otherwise(F.array(whole("any")))).alias("key"))
    lengths = upto(F.greatest(F.lit(4), F.col("_n") - 2), F.col("_n") + 2)
    parts = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(upto(F.lit(0), edits(n)), lambda i: shifted(n, i)))))
    held = F.concat(F.when(F.col("_plain"), parts).otherwise(F.array(whole("shifting"))), F.array(whole("any")))
    known = keyed(words, "word").select("word", F.explode(F.array_distinct(held)).alias("key"))
    return asked.join(known, "key").select("token", "word")


def corrections(tokens: DataFrame, words: DataFrame, least: float = 0.88) -> DataFrame:
    """(token, word, ratio): the best safe correction of each unknown token (O-088, O-190).

    The ratio is computed for ``alike`` pairs only, so its calls do not grow with the square of a block.
    """
    unknown = tokens.select("token").distinct().filter(F.length("token") >= 4).join(words, F.col("token") == F.col("word"), "left_anti")
    pairs = alike(unknown, words, least).filter(T.safe_to_correct(F.col("token"), F.col("word"))).distinct()
    scored = pairs.withColumn("ratio", U.ratio(F.col("token"), F.col("word"))).filter(F.col("ratio") >= least)
    order = Window.partitionBy("token").orderBy(F.col("ratio").desc(), "word")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("token", "word", "ratio")


def semantic_rows(catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Row text for embedding: non-null cells joined by ' | ' (O-134, O-253)."""
    return catalog.withColumn("row_text", F.concat_ws(" | ", *columns))
