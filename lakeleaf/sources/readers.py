"""Readers of the engine's inputs, all on Spark's own sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions import text as T
from ..functions import udfs as U

ARTICLE = "doc_id string, doc_issue string, article_no int, author_name string, title string, content string, year string, source_document string"
AUTHORS = "array<struct<doc_id:string,doc_issue:string,authors:array<string>>>"
REGISTRY = "id string, name map<string,string>, volumes array<struct<id:string,year:int,cover_image:string,issues:array<struct<num:string,year:int,pdf_url:string>>>>"
SAMPLE = "id string, question string, human_answer string, llm_answer string, category string, notes string"


def listing(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """(path, length, modified) of the files below a root, empty ones and folder markers left out (O-001)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).filter("length > 0")


def binaries(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path", "content")


def text_lines(spark: SparkSession, root: str) -> DataFrame:
    """(source_document, line_no, line) (O-003)."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.input_file_name().alias("source_document"), "value")
    return texts.select("source_document", F.posexplode(F.split("value", r"\R")).alias("line_no", "line"))


def docx_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of DOCX files; text is null for what cannot be read (O-006)."""
    return binaries(spark, root, ".docx").select("path", U.docx(F.col("content")).alias("text"))


def catalogue(spark: SparkSession, path: str, columns: list[str], tolerant: bool = True) -> DataFrame:
    """A CSV with a header, every column a string; header blanks stripped, bad lines kept with nulls or dropped.

    A missing file is an empty table (O-007 to O-009).
    """
    try:
        df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("multiLine", True).option("mode", "PERMISSIVE" if tolerant else "DROPMALFORMED").csv(path)
    except AnalysisException:
        return spark.createDataFrame([], P.StructType([P.StructField(c, P.StringType()) for c in columns]))
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.select(*(F.col(f"`{c}`").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def json_records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(root)


def is_authors_file(path) -> bool:
    return F.lower(path).endswith("authors.json")


def is_remaining_file(path):
    return F.contains(F.lower(path), F.lit("remaining_vol"))


def articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles of all article files with content, author names as arrays (O-012, O-014)."""
    files = spark.read.schema(f"articles array<struct<{', '.join(x.replace(' ', ':', 1) for x in ARTICLE.split(', '))}>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    path = F.input_file_name()
    rows = files.withColumn("s3_key", path).filter(~is_authors_file(F.col("s3_key")) & ~is_remaining_file(F.col("s3_key")))
    one = rows.select("s3_key", F.explode("articles").alias("a")).select("s3_key", "a.*").filter(T.strip(F.coalesce("content", F.lit(""))) != "")
    listed = F.from_json("author_name", "array<string>")
    return one.withColumn("authors", F.when(F.col("author_name").startswith("["), F.coalesce(listed, T.authors_of(F.col("author_name")))).otherwise(T.authors_of(F.col("author_name")))).withColumn("volume", T.volume_of(F.col("s3_key")))


def issue_authors(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, doc_issue, author) of the author files (O-013)."""
    files = spark.read.schema("doc_id string, doc_issue string, authors array<string>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*authors.json").json(root)
    return files.select("doc_id", "doc_issue", F.explode("authors").alias("author")).withColumn("author", F.trim("author")).filter("author <> ''")


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).option("multiLine", True).json(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples of a .json array or a .csv; rows without question or human answer go, ids are made up where missing (O-017)."""
    from ..functions.numbering import numbered

    if path.endswith(".json"):
        df = spark.read.schema(SAMPLE).option("multiLine", True).json(path)
    elif path.endswith(".csv"):
        df = catalogue(spark, path, [c.split()[0] for c in SAMPLE.split(", ")])
    else:
        raise ValueError(f"neither .json nor .csv: {path}")
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    df = df.select("id", blank("question"), blank("human_answer"), blank("llm_answer"), "category", "notes").filter("question is not null and human_answer is not null")
    return numbered(df, [F.col("question"), F.col("human_answer"), F.col("id")], "_n").withColumn("id", F.coalesce("id", F.concat(F.lit("sample_"), F.col("_n")))).drop("_n")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_key, gain) of a JSON map of maps (O-018)."""
    texts = spark.read.option("wholetext", True).text(path)
    outer = texts.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("qid", "m"))
    return outer.select("qid", F.explode("m").alias("doc_key", "gain"))


def remaining_context(articles_: DataFrame, least: int = 50, each: int = 400, most: int = 3000) -> DataFrame:
    """(volume, context) of leftover articles (O-019)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_no", F.substring("content", 1, each).alias("c")))), lambda x: x["c"]), "\n\n")
    return articles_.filter(F.length("content") > least).groupBy("volume").agg(F.substring(body, 1, most).alias("context"))


def unprocessed(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs whose normalised key has no output yet (O-020)."""
    return inputs.withColumn("_key", T.normal_key(F.col("path"))).join(outputs.select(T.normal_key(F.col("path")).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads; other errors are raised (O-005)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_processed(spark: SparkSession, path: str) -> bool:
    """Whether an output is there and holds an object with a list of articles (O-259)."""
    if not exists(spark, path):
        return False
    found = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "struct<articles:array<string>>").alias("j"))
    return not found.filter("j.articles is not null").isEmpty()


def index_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored description of an index; None where there is none (O-257)."""
    return spark.read.json(path) if exists(spark, path) else None


def publication(registry_: DataFrame, name: str) -> DataFrame:
    """The registry's entry of an id; an unknown one is an error (O-016)."""
    found = registry_.filter(F.col("id") == name)
    if found.isEmpty():
        raise ValueError(f"unknown publication {name}")
    return found
