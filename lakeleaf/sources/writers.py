"""Sinks.  Nothing overwrites a path that it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def article_files(articles: DataFrame, path: str) -> None:
    """One folder per source document (O-031)."""
    articles.repartition("source_document").write.mode("overwrite").partitionBy("source_document").json(path)


def remaining_by_volume(articles: DataFrame) -> DataFrame:
    """{doc_id, issues: [...], total_remaining} per volume (O-033)."""
    fields = F.struct("article_no", "title", "author_name", "content", "source_document")
    issues = articles.groupBy("doc_id", "doc_issue").agg(F.min("source_document").alias("source_document"), F.count("*").alias("article_count"), F.array_sort(F.collect_list(fields)).alias("articles"))
    return issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("doc_issue", "source_document", "article_count", "articles"))).alias("issues"), F.sum("article_count").alias("total_remaining"))


def csv_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def judgement_json(qrels: DataFrame) -> DataFrame:
    """One JSON line per query: a map of its judgements (O-038)."""
    per = qrels.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_key", "gain")))).alias("m"))
    return per.select(F.to_json(F.create_map("qid", "m")).alias("value"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of (path, content), with 'VOL 1 ...' folders as 'Vol1' (O-042)."""
    place = F.regexp_replace("path", r"(?i)(^|/)VOL\s*(\d+)[^/]*/", "$1Vol$2/")
    return files.select(place.alias("path"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def ablation_markdown(averages: DataFrame, metrics: list[str]) -> str:
    """A table of one row per system, four decimals (O-040)."""
    rows = averages.orderBy("system").select("system", *(F.format_number(F.col(f"`{m}`"), 4).alias(m) for m in metrics)).collect()
    head = ["system", *metrics]
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows])


def texts(rows: DataFrame, path: str, column: str = "value") -> None:
    """UTF-8 lines (O-030)."""
    rows.select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per row, non-ASCII characters as they are (O-030, O-041)."""
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def points_table(points: DataFrame, path: str) -> None:
    """A full rebuild of the index: a folder per type, sorted by the filter fields, so that files' statistics prune (O-035, O-036)."""
    keys = [c for c in ("volume", "doc_id", "doc_issue", "article_no", "chunk_id") if c in points.columns]
    points.repartition("type", *keys[:2]).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("type").parquet(path)


def version_of(path: str, name: str) -> str:
    """The folder of a named version of a table: versions are never overwritten, and a reader names one (O-043)."""
    return f"{path.rstrip('/')}/version={name}"


def index_metadata(points: DataFrame, source_hash: str, fingerprint: str, place: str, **settings: str) -> DataFrame:
    """One row that describes an index: fingerprint, hash of its sources, place, number of points, time, settings (O-257)."""
    row = points.agg(F.count("*").alias("points_count"))
    named = {"embedding_fingerprint": fingerprint, "source_data_hash": source_hash, "snapshot_key": place} | settings
    return row.select(*(F.lit(v).alias(k) for k, v in named.items()), "points_count", F.current_timestamp().alias("indexed_at"))


def report_tables(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """A report as two CSV tables, one per sheet (O-039)."""
    csv_table(summary, f"{path}/summary")
    csv_table(metrics, f"{path}/per_query")
