"""Issues: headers of files, catalogue rows of an issue, shared authors, and keys derived from an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U

FESTIVAL = r"பொங்கல்\s*மலர்"
VOLUME, ISSUE = r"மலர்\s*[:—\-]?\s*", r"இதழ்\s*[:—\-]?\s*"
IMAGE_SUFFIXES = ("jpg", "png", "jpeg")


def header_numbers(lines: DataFrame, first: int = 50) -> DataFrame:
    """(source_document, volume, issue, year) from a file's first lines, joined; all null unless volume and issue are found (O-173).

    The festival issue names both; other numbers lose leading zeros.
    """
    rows = lines.filter(F.col("line_no") < first)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")  # ``first`` lines at most
    found = rows.groupBy("source_document").agg(body.alias("t"))
    group = lambda p: F.nullif(F.regexp_extract("t", p, 1), F.lit(""))
    number = lambda p: F.regexp_replace(group(p + r"(\d+)"), r"^0+(?=\d)", "")
    festival = F.col("t").rlike(FESTIVAL)
    volume, issue = F.when(festival, "பொங்கல்").otherwise(number(VOLUME)), F.when(festival, "பொங்கல் மலர்").otherwise(number(ISSUE))
    both = volume.isNotNull() & issue.isNotNull()
    year = group(r"((?:19|20)\d{2})")
    return found.select("source_document", F.when(both, volume).alias("volume"), F.when(both, issue).alias("issue"), F.when(both, year).alias("year"))


def header_lines(lines: DataFrame, head: int = 150, tail: int = 50) -> DataFrame:
    """(source_document, doc_id, doc_issue) by the first line of the head, else of the tail, that names each; 'NA' where none does (O-173)."""
    top = F.max("line_no").over(Window.partitionBy("source_document"))
    area = lines.withColumn("_top", top).withColumn("_area", F.when(F.col("line_no") < head, 0).when(F.col("line_no") > F.col("_top") - tail, 1)).filter("_area is not null")
    first = lambda p: F.coalesce(F.min_by(*_named(p)), F.lit("NA"))

    def _named(pattern: str) -> tuple[Column, Column]:
        value = F.nullif(F.regexp_extract("line", pattern + r"(\d{1,3})", 1), F.lit(""))
        return value, F.when(value.isNotNull(), F.struct("_area", "line_no"))

    return area.groupBy("source_document").agg(first(VOLUME).alias("doc_id"), first(ISSUE).alias("doc_issue"))


def catalogue_rows(files: DataFrame, catalog: DataFrame, least: float = 0.8) -> DataFrame:
    """Catalogue rows (volume, issue, ...) of files (source_document, volume, issue): equal issues, else similar ones of the volume (O-084, O-258).

    Similar: one holds the other, or their ratio reaches ``least``.  Both joins are
    equi-joins on the volume; the second has only the files that the first leaves.
    """
    plain = lambda c: T.strip(T.canonical(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    named = files.select("source_document", plain("volume").alias("_v"), plain("issue").alias("_i"))
    rows = catalog.withColumn("_v", plain("volume")).withColumn("_c", plain("issue"))
    exact = named.join(rows, "_v").filter(F.col("_i") == F.col("_c"))
    rest = named.join(exact.select("source_document").distinct(), "source_document", "left_anti")
    pairs = rest.join(rows, "_v").withColumn("_ratio", U.ratio(F.col("_i"), F.col("_c")))
    similar = pairs.filter(F.contains("_c", F.col("_i")) | F.contains("_i", F.col("_c")) | (F.col("_ratio") >= least)).drop("_ratio")
    return exact.withColumn("matched", F.lit("exact")).unionByName(similar.withColumn("matched", F.lit("similar"))).drop("_v", "_i", "_c")


def shared_authors(articles: DataFrame, files: DataFrame) -> DataFrame:
    """Articles (doc_id, doc_issue, ...) with ``shared``: the authors of the first file (by file_order) of their issue; none where no file has any (O-089)."""
    first = files.filter(F.size("authors") > 0).groupBy("doc_id", "doc_issue").agg(F.min_by("authors", "file_order").alias("shared"))
    none = F.expr("cast(array() as array<string>)")
    return articles.join(first, ["doc_id", "doc_issue"], "left").withColumn("shared", F.coalesce("shared", none))


def distinct_authors(rows: DataFrame) -> DataFrame:
    """(doc_id, doc_issue, place, author): the authors of an issue once each, by normalised name, as first seen (O-114).  rows have a position."""
    named = rows.withColumn("_key", T.author_key(U.nfc(F.col("author"))))
    first = named.filter("_key <> ''").groupBy("doc_id", "doc_issue", "_key").agg(F.min(F.struct("position", "author")).alias("f"))
    place = F.row_number().over(Window.partitionBy("doc_id", "doc_issue").orderBy("f.position", "f.author"))
    return first.select("doc_id", "doc_issue", place.alias("place"), F.col("f.author").alias("author"))


def article_projection(catalog: DataFrame) -> DataFrame:
    """title, author as shown, year, issue, and numbers ``serial`` and ``order_no`` of a catalogue of strings (O-254).

    Numbers are whole where they can be cast, else their text is kept; null stays null.
    """
    whole = lambda c: F.coalesce(F.expr(f"try_cast(try_cast({c} as double) as bigint)").cast("string"), F.col(c).cast("string")).alias(c)
    author = T.author_display(T.authors_of(F.col("author"))).alias("author")
    return catalog.select(F.coalesce("title", F.lit("")).alias("title"), author, whole("year"), F.col("issue").cast("string").alias("issue"), whole("serial"), whole("order_no"))


def same_number(a: Column, b: Column) -> Column:
    """Article numbers compare as numbers where both are digits, else as text (O-054)."""
    return T.canonical(a.cast("string")) == T.canonical(b.cast("string"))


def without_brackets(c: Column) -> Column:
    """An author cell without brackets and quotes, trimmed (O-063)."""
    return F.trim(F.translate(c, "[]\"'", ""))


def key_candidates(key: Column) -> Column:
    """A key and its names with the other image suffixes, in the order to try; a key without a suffix stands alone (O-183)."""
    at = F.length(key) - F.instr(F.reverse(key), ".")
    base, suffix = F.substring(key, F.lit(1), at), F.lower(F.substring(key, at + 2, F.length(key)))
    others = F.transform(F.filter(F.array(*map(F.lit, IMAGE_SUFFIXES)), lambda s: s != suffix), lambda s: F.concat(base, F.lit("."), s))
    return F.when(F.contains(key, F.lit(".")), F.concat(F.array(key), others)).when(key.isNotNull(), F.array(key))


def keys_of(issues: DataFrame, folder: str, file: str) -> DataFrame:
    """Adds key from templates with {volume}, {issue} and {year}; null where no issue is registered (O-183)."""
    out = F.lit(folder + file)
    for name in ("volume", "issue", "year"):
        out = F.replace(out, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return issues.withColumn("key", out)


def drive_id(url: Column) -> Column:
    """What stands between /d/ and the next slash of a sharing link; null without it (O-183)."""
    return F.nullif(F.regexp_extract(url, "/d/([^/]+)", 1), F.lit(""))


def client_address(forwarded: Column, host: Column) -> Column:
    """The first hop of a forwarding header, else the peer (O-262)."""
    return F.coalesce(F.nullif(F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1))), F.lit("")), host)
