"""From articles to index rows: chunks, tags, points, statistics, change detection."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import udfs as U
from ..session import in_batches

KEYS = ("doc_id", "doc_issue", "article_no")


def chunk_rows(articles: DataFrame, keys: list[str], column: str = "content", size: int = L.CHUNK_SIZE) -> DataFrame:
    """keys, chunk_id, total_chunks, content: ordinals count invalid chunks too, so filter afterwards (O-160)."""
    rows = articles.select(*keys, T.counted_sentences(F.col(column)).alias("_parts")).withColumn("_chunks", T.chunks("_parts", size))
    # Outer, or Catalyst infers a filter on the number of chunks, pushes it down and so cuts every text twice.
    cut = rows.select(*keys, F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_id", "content"))
    return cut.filter("chunk_id is not null")


def chunk_stats(chunks: DataFrame, tamil: bool = True) -> DataFrame:
    """Chunks, valid and invalid ones, and words per valid chunk (O-108)."""
    rows = chunks.select(T.chunk_ok(F.col("content"), tamil).alias("ok"), T.word_count(F.col("content")).alias("n"))
    valid = F.when(F.col("ok"), F.col("n"))
    return rows.agg(F.count("*").alias("chunks"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), F.min(valid).alias("least_words"), F.max(valid).alias("most_words"), F.floor(F.avg(valid)).alias("mean_words"))


def rule_tags(title, has_author):
    """Categories of a title in the order of the rules; a known serial with an author is fiction first (O-200)."""
    title = T.strip(F.coalesce(title, F.lit("")))
    serial = F.when(title.isin(*L.SERIAL_TITLES) & has_author, F.lit("FICTION"))
    tags = [serial]
    for category, (exact, parts) in L.TITLE_RULES.items():
        hit = F.lit(False)
        if exact:
            hit = hit | title.isin(*exact)
        for p in parts:
            hit = hit | title.contains(p)
        tags.append(F.when(hit, F.lit(category)))
    return F.array_distinct(F.array_compact(F.array(*tags)))


def tamil_tags(tags):
    """Tamil names, unknown ids skipped (O-204)."""
    names = F.create_map(*(F.lit(x) for tag, (tamil, _) in L.TAXONOMY.items() for x in (tag, tamil)))
    return F.array_compact(F.transform(tags, lambda t: F.try_element_at(names, t)))


def tfidf_vectors(documents: DataFrame, vocabulary_size: int = 5000, min_df: int = 2, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """((id, term, weight) unit vectors, (term, idf)) over (id, text): smooth idf, l2 norm, the most frequent terms (O-201)."""
    terms = documents.select("id", F.explode(T.matches(F.lower("text"), T.TAMIL_OR_WORD)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = documents.count()
    df = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    kept = df.orderBy(F.col("total").desc(), "term").limit(vocabulary_size)
    idf = kept.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    return unit_vectors(terms, idf), idf


def unit_vectors(terms: DataFrame, idf: DataFrame) -> DataFrame:
    weighed = terms.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_tags(vectors: DataFrame, idf: DataFrame, keywords: dict[str, str] = L.CATEGORY_KEYWORDS, threshold: float = L.TFIDF_THRESHOLD, most: int = 3) -> DataFrame:
    """(id, tag, similarity, rank): categories by cosine, GENERAL only where nothing else qualifies (O-202)."""
    spark = vectors.sparkSession
    rows = [(name, i, word) for i, (name, text) in enumerate(keywords.items()) for word in text.split()]
    asked = spark.createDataFrame(rows, "id string, position int, term string")
    own = unit_vectors(asked.groupBy("id", "term").agg(F.count("*").alias("tf")), idf).select(F.col("id").alias("tag"), "term", F.col("weight").alias("kw"))
    scored = vectors.join(F.broadcast(own), "term").groupBy("id", "tag").agg(F.round(F.sum(F.col("weight") * F.col("kw")), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    position = asked.select(F.col("id").alias("tag"), "position").distinct()
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "position")
    named = scored.filter("tag <> 'GENERAL'").join(F.broadcast(position), "tag")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("id", "tag", "similarity", "rank")


def tag_articles(articles: DataFrame) -> DataFrame:
    """Adds tags and tags_tamil to (article key, title, authors, content): rules, else TF-IDF, else GENERAL; three at most (O-203)."""
    rows = articles.withColumn("id", F.concat_ws("|", *KEYS)).withColumn("_rules", rule_tags(F.col("title"), F.size(F.coalesce("authors", F.expr("cast(array() as array<string>)"))) > 0))
    texts = rows.select("id", F.concat_ws(" ", "title", F.substring("content", 1, 500)).alias("text"))
    vectors, idf = tfidf_vectors(texts)
    similar = tfidf_tags(vectors, idf).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda t: t["tag"]).alias("_similar"))
    tags = F.when(F.size("_rules") > 0, F.slice("_rules", 1, 3)).otherwise(F.coalesce("_similar", F.array(F.lit("GENERAL"))))
    return rows.join(similar, "id", "left").withColumn("tags", tags).withColumn("tags_tamil", tamil_tags(F.col("tags"))).drop("id", "_rules", "_similar")


def points(tagged: DataFrame, size: int = L.CHUNK_SIZE, embedder=None) -> DataFrame:
    """Index rows of tagged articles: valid chunks with a name-based id (O-034, O-035).

    ``embedder`` is a column function for the dense vector of ``passage: `` texts (O-250).
    """
    keys = [c for c in tagged.columns if c != "content"]
    out = chunk_rows(tagged, keys, size=size).filter(T.chunk_ok(F.col("content")))
    name = F.concat_ws("-", F.col("s3_key"), F.col("doc_id").cast("string"), F.col("article_no").cast("string"), F.col("chunk_id").cast("string"))
    out = out.withColumn("point_id", U.point_id(name)).withColumn("type", F.lit("article")).withColumn("volume", T.volume_of(F.col("s3_key")))
    return out.withColumn("dense", embedder(F.concat(F.lit("passage: "), F.col("content")))) if embedder else out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with their keys (O-032, O-034)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def source_hash(listing: DataFrame) -> DataFrame:
    """SHA-256 of the sorted 'key|time' lines (O-113); of nothing for an empty listing.

    Lines are sorted by ranges in many tasks, which pack them, so that the one task that
    the sequential digest needs sorts a compressed pack for up to some thousand lines.
    """

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                lines = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({"first": lines[:1], "last": lines[-1:], "pack": [zlib.compress("\n".join(lines).encode(), 1)]})

    def digested(batches):
        import pyarrow as pa

        found, first = hashlib.sha256(), True
        for batch in batches:
            for pack in batch.column(0):
                found.update((b"" if first else b"\n") + zlib.decompress(pack.as_py()))
                first = False
        yield pa.RecordBatch.from_pydict({"source_hash": [None if first else found.hexdigest()]})

    line = F.concat_ws("|", F.col("key").cast("string"), F.col("modified").cast("string")).alias("line")
    ordered = listing.select(line).repartitionByRange("line").sortWithinPartitions("line")
    packs = in_batches(ordered, packed, "first string, last string, pack binary")
    # Packs that begin with the same line hold nothing else, but for the one with the largest last line.
    found = in_batches(packs.repartition(1).sortWithinPartitions("first", "last").select("pack"), digested, "source_hash string")
    return found.agg(F.coalesce(F.max("source_hash"), F.lit(hashlib.sha256(b"").hexdigest())).alias("source_hash"))


def needs_reindex(now: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: whether fingerprint or source hash differ, or nothing is stored (O-244)."""
    rows = now.select(F.col("fingerprint").alias("f"), F.col("source_hash").alias("h")).crossJoin(F.broadcast(stored.agg(F.max("fingerprint").alias("sf"), F.max("source_hash").alias("sh"), F.count("*").alias("n"))))
    return rows.select((F.col("n") == 0).__or__(~F.col("f").eqNullSafe(F.col("sf"))).__or__(~F.col("h").eqNullSafe(F.col("sh"))).alias("needs_reindex"))
