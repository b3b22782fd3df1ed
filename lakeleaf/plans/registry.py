"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it.

``documents`` stand for articles (source for volume, lang for category), ``benchmark``
for questions, ``embeddings`` for dense vectors, ``labels.quality`` for gains,
``conversations`` for histories and ``events`` for the request log.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import udfs as U
from ..operators import answers, catalog, evaluation, indexing, ranking, retrieval, segmentation, spelling, state, understanding

from ..session import checkpoint, scratch
from ..sources import readers, versions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
WORDS = r"regexp_extract_all({}, '[\x{{0B80}}-\x{{0BFF}}]+|[\p{{L}}\p{{N}}_]+')"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def kept(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return kept


#: Semantics over a few rows made for them, with their SQL: tests, not registered queries, as they read no table.
CASES: dict = {}
CASES_SQL: dict[str, str] = {}


def case(sql: str):
    """Keeps a function and its SQL under its name for the tests."""

    def kept(f):
        CASES[f.__name__], CASES_SQL[f.__name__] = f, sql
        return f

    return kept


#: Tables of texts, whose rows are worth more work than dealing them.
TEXTS = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose scan has fewer tasks than there are cores is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


# --- Facets and listings ---


@query("select source, lang, count(*) as articles, count(distinct text) as texts, min(n_chars) as least_chars, max(n_chars) as most_chars from documents group by source, lang")
def facet_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("articles"), F.count_distinct("text").alias("texts"), F.min("n_chars").alias("least_chars"), F.max("n_chars").alias("most_chars"))


@query("select count(*) as issues, cast(sum(articles) as bigint) as articles, round(avg(articles), 1) as mean, min(articles) as least, max(articles) as most from (select source, count(*) as articles from documents where trim(source) <> '' group by source)")
def facet_stats(spark, d):
    return catalog.issue_stats(catalog.issue_counts(table(spark, d, "documents").select(F.col("source").alias("issue"))))


@query("select o_orderpriority as author, count(*) as articles from orders group by 1")
def author_counts(spark, d):
    return catalog.author_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("author")))


@query("select cast(min(try_cast(substr(cast(o_orderdate as varchar), 1, 4) as integer)) as integer) as start_year from orders")
def start_year(spark, d):
    return catalog.start_year(table(spark, d, "orders").select(F.substring(F.col("o_orderdate").cast("string"), 1, 4).alias("year")))


@query("select source as volume, count(*) as issues, case when count(distinct y) > 1 then cast(min(y) as varchar) || '-' || cast(max(y) as varchar) else cast(min(y) as varchar) end as years from (select source, n_chars % 8 + 1947 as y from documents) group by source")
def volume_summary(spark, d):
    return catalog.volume_summary(table(spark, d, "documents").select(F.col("source").alias("volume"), (F.col("n_chars") % 8 + 1947).alias("year")))


@query("select o_orderkey, index from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as index, count(*) over () as n from orders) where index <= 10 or index > n - 10")
def issue_first_last10(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ranking.first_and_last(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "index")


@query("select doc_id, lang, source from documents where lang = 'fr' and contains(lower(text), 'vi')")
def browse_filter(spark, d):
    docs = table(spark, d, "documents")
    points = docs.select("doc_id", F.col("source").alias("doc_issue"), F.col("doc_id").alias("article_no"), F.lit(0).alias("chunk_id"), F.array("lang").alias("tags"), F.array("source").alias("authors"), F.col("text").alias("title"), "lang", "source")
    return points.filter(F.array_contains("tags", "fr") & F.contains(F.lower("title"), F.lit("vi"))).select("doc_id", "lang", "source")


@query("select c.doc_id, coalesce(nullif(case when l.doc_id is not null then l.quality || ', ' || l.toxic end, ''), i.first_tag, '') as tag_text from documents c left join labels l on l.doc_id = c.doc_id left join (select source, arg_min(quality || ', ' || toxic, d.doc_id) as first_tag from documents d join labels using (doc_id) group by source) i on i.source = c.source")
def catalog_tag_backfill(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    keyed = docs.select("doc_id", F.col("source").alias("doc_issue"), F.col("doc_id").alias("article_no"))
    rows = keyed.select(F.lit(1).alias("doc_id"), "doc_issue", "article_no")
    tagged = keyed.join(labels, "doc_id").select(F.lit(1).alias("doc_id"), "doc_issue", "article_no", F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("tags"))
    return catalog.with_tags(rows, tagged).select(F.col("article_no").alias("doc_id"), "tag_text")


# --- Text ---


@query(f"select lang, sum(n) as words, min(n) as least, max(n) as most from (select lang, len({WORDS.format('text')}) as n from documents) group by lang".replace("sum(n)", "cast(sum(n) as bigint)"))
def word_count_stats(spark, d):
    rows = table(spark, d, "documents").select("lang", T.word_count(F.col("text")).cast("bigint").alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most"))


SENTENCES_SQL = r"""
parts as (select doc_id, unnest(regexp_extract_all(text, '[^।.!?]*[।.!?]*')) as m, generate_subscripts(regexp_extract_all(text, '[^।.!?]*[।.!?]*'), 1) as i from documents),
sentences as (select doc_id, i, regexp_replace(regexp_extract(m, '^([^।.!?]*)', 1), '^[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') || regexp_extract(m, '([।.!?]*)$', 1) as t from parts)"""


@query(f"with {SENTENCES_SQL} select doc_id, count(*) as sentences, cast(sum(length(t)) as bigint) as chars, min(md5(t)) as first_md5 from sentences where length(t) > 10 group by doc_id")
def sentence_explode(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("t").cast("long")).alias("chars"), F.min(F.md5(F.col("t").cast("binary"))).alias("first_md5"))


CHUNKS_SQL = rf"""
{SENTENCES_SQL.strip()},
counted as (select doc_id, t, len({WORDS.format('t')}) as w, row_number() over (partition by doc_id order by i) as k from sentences where length(t) > 10),
fold as (
  select doc_id, 0 as k, cast(null as varchar) as cur, 0 as n, cast([] as varchar[]) as out from (select distinct doc_id from counted)
  union all
  select f.doc_id, f.k + 1,
    case when w > {{most}} then null when n + w > {{most}} and cur is not null then if(w >= {{target}}, null, t) when n + w >= {{target}} then null else concat_ws(' ', cur, t) end,
    case when w > {{most}} then 0 when n + w > {{most}} and cur is not null then if(w >= {{target}}, 0, w) when n + w >= {{target}} then 0 else n + w end,
    case when w > {{most}} then if(cur is null, [t], [cur, t]) when n + w > {{most}} and cur is not null then if(w >= {{target}}, [cur, t], [cur]) when n + w >= {{target}} then [concat_ws(' ', cur, t)] else [] end
  from fold f join counted c on c.doc_id = f.doc_id and c.k = f.k + 1),
closed as (
  select doc_id, k, out from fold
  union all select doc_id, k + 1, [cur] from (select *, max(k) over (partition by doc_id) as top from fold) where k = top and n >= 10),
listed as (select doc_id, k, unnest(out) as content, generate_subscripts(out, 1) as j from closed),
chunks as (select doc_id, row_number() over (partition by doc_id order by k, j) - 1 as chunk_id, count(*) over (partition by doc_id) as total_chunks, content from listed),
judged as (select *, len({WORDS.format('content')}) as words, length(regexp_replace(content, '^[\s\x0b\x{{{{1c}}}}-\x{{{{1f}}}}\x{{{{85}}}}\p{{{{Z}}}}]+|[\s\x0b\x{{{{1c}}}}-\x{{{{1f}}}}\x{{{{85}}}}\p{{{{Z}}}}]+$', '', 'g')) >= 20 and len({WORDS.format('content')}) >= 10 as ok from chunks)"""


def chunks_sql(size: int = L.CHUNK_SIZE) -> str:
    """The chunks of documents: ``judged`` (doc_id, chunk_id, total_chunks, content, words, ok)."""
    return CHUNKS_SQL.replace("{most}", str(int(size // 6 * 1.5))).replace("{target}", str(size // 6)).replace("{{", "{").replace("}}", "}")


@query(f"with recursive {chunks_sql()} select doc_id, cast(chunk_id as integer) as chunk_id, cast(total_chunks as integer) as total_chunks, cast(words as integer) as words, md5(content) as content_md5 from judged where ok")
def chunk_greedy(spark, d):
    return indexing.chunk_rows(table(spark, d, "documents"), ["doc_id"], "text").filter(T.chunk_ok(F.col("content"), tamil=False)).select("doc_id", "chunk_id", "total_chunks", T.word_count(F.col("content")).alias("words"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"with recursive {chunks_sql()} select count(*) as chunks, count(*) filter (ok) as valid, count(*) filter (not ok) as invalid, cast(min(words) filter (ok) as integer) as least_words, cast(max(words) filter (ok) as integer) as most_words, cast(floor(avg(words) filter (ok)) as bigint) as mean_words from judged")
def chunk_stats(spark, d):
    return indexing.chunk_stats(indexing.chunk_rows(table(spark, d, "documents"), ["doc_id"], "text"), tamil=False)


MERGED_SQL = "trim(regexp_replace(string_agg(content, ' ' order by chunk_id), '[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g'))"


@query(f"with recursive {chunks_sql()} select doc_id, chunk_count, word_count, md5(content) as content_md5 from (select doc_id, count(*) as chunk_count, {MERGED_SQL} as content, len({WORDS.format(MERGED_SQL)}) as word_count from judged where ok group by doc_id) where word_count >= 50")
def chunk_reassemble(spark, d):
    """Every document's valid chunks by number, joined by blanks and collapsed; results under 50 words go (O-106)."""
    docs = table(spark, d, "documents")
    chunks = indexing.chunk_rows(docs, ["doc_id"], "text").filter(T.chunk_ok(F.col("content"), tamil=False))
    points = chunks.select(F.lit("v").alias("volume"), F.col("doc_id").alias("doc_id"), F.lit("i").alias("doc_issue"), F.lit("").alias("title"), "chunk_id", "content", F.lit("article").alias("type"))
    # Every document is hit; those without a valid chunk drop out, so chunks are cut once.
    hits = docs.select(F.lit(1).alias("qid"), F.lit("v").alias("volume"), "doc_id", F.lit("i").alias("doc_issue"), F.lit("").alias("title"), F.lit(1.0).alias("score")).distinct()
    return retrieval.merge_chunks(hits, points).select("doc_id", "chunk_count", F.col("word_count").cast("bigint").alias("word_count"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("select source, count(*) as chunks, md5(string_agg(text, chr(10) order by doc_id)) as content_md5 from documents group by source")
def article_lines(spark, d):
    """Texts of a source by line, in the order of their ids (O-107)."""
    docs = table(spark, d, "documents")
    points = docs.select(F.lit("v").alias("doc_id"), F.col("source").alias("doc_issue"), F.lit(1).alias("article_no"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("title"))
    return catalog.article_content(points).select(F.col("doc_issue").alias("source"), "chunks", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("select distinct unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as word from documents")
def vocab_build(spark, d):
    return catalog.vocabulary(table(spark, d, "documents"), "text", "[a-z]{4,}")


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '["'']', '', 'g'), '={4,}', '---', 'g'), '`{3,}', '''', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {3,}', ' ', 'g'), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g') as clean from conversations""")
def sanitize_queries(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.sanitize(F.col("text")).alias("clean"))


@query(
    "select conv_id, turn, case when regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in L.INJECTION_HIGH).replace("'", "''") + "') then 'high' when regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in L.INJECTION_MEDIUM) + "') then 'medium' end as severity from conversations"
)
def injection_flags(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.injection_severity(F.col("text")).alias("severity"))


@query(
    "select conv_id, turn, coalesce(regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in L.LEAKAGE).replace("'", "''") + "'), false) as leaks, coalesce(regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in L.NO_DATA_ENGLISH).replace("'", "''") + "') or regexp_matches(text, '" + "|".join(f"(?:{p})" for p in L.NO_DATA_TAMIL) + "'), false) as no_data from conversations"
)
def answer_guards(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.leaks(F.col("text")).alias("leaks"), T.says_no_data(F.col("text")).alias("no_data"))


@query(r"select page_id, replace(regexp_replace(lower(url), '[\s\p{Z}]+', '_', 'g'), '_.', '.') as file_key, case when regexp_extract(url, '((?:19|20)\d{2})', 1) = '' then 'Unknown' else regexp_extract(url, '((?:19|20)\d{2})', 1) end as year, coalesce(list_filter(string_split(url, '/'), lambda p: starts_with(lower(p), 'vol_'))[1], 'unknown') as volume, rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') as token from pages")
def key_parse(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", T.normal_key(url).alias("file_key"), T.year_of(url).alias("year"), T.volume_of(url).alias("volume"), T.base64url(url.cast("binary")).alias("token"))


@query(r"select item_id, array_to_string(list_filter(regexp_extract_all(lower(nfc_normalize(text)), '[\x{0B80}-\x{0BFF}a-z0-9]+'), lambda t: length(t) >= 2), ' ') as content_tokens from benchmark")
def content_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.content_tokens(U.nfc(F.col("text"))), " ").alias("content_tokens"))


# --- Retrieval ---

BM25_SQL = f"""
q as (select item_id as qid, text from benchmark),
qt as (select distinct qid, unnest({TOKENS.format('text')}) as term from q),
dt as (select doc_id, unnest({TOKENS.format('text')}) as term from documents),
dl as (select doc_id, len({TOKENS.format('text')}) as dl from documents),
tot as (select count(*) as n, avg(dl) as avgdl from dl),
tf as (select doc_id, term, count(*) as tf from dt where term in (select term from qt) group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
bm as (select qid, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {L.BM25_K1 + 1} / (tf + {L.BM25_K1} * ({1 - L.BM25_B} + {L.BM25_B} * dl / avgdl))), 6) as score from qt join tf using (term) join df using (term) join dl using (doc_id), tot group by qid, doc_id),
sparse as (select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from bm) where rank <= {{k}})"""


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def sparse(spark, d, limit: int) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), questions(spark, d), limit)


@query(f"with {BM25_SQL.replace("{k}", "10")} select qid, doc_id, score, rank from sparse")
def bm25_topk(spark, d):
    return sparse(spark, d, 10)


DENSE_SQL = """
dq as (select vec_id as qid, embedding as e from embeddings where vec_id % 100 = 0),
dense as (select qid, vec_id, score, rank from (select qid, vec_id, score, row_number() over (partition by qid order by score desc, vec_id) as rank from (
  select qid, vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: cast(embedding[i] as double) * cast(e[i] as double))), 6) as score from embeddings, dq {where}) where score >= 0.2) where rank <= {k})"""


def vector_queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(f"with {DENSE_SQL.format(k=20, where='')} select qid, vec_id, score, rank from dense")
def dense_topk(spark, d):
    """The query set is stated: every vector whose id is divisible by 100, against all vectors."""
    return retrieval.dense(table(spark, d, "embeddings"), vector_queries(spark, d), 20, 0.2)


@query(f"with {DENSE_SQL.format(k=20, where='where label in (0, 3)')} select qid, vec_id, score, rank from dense")
def dense_topk_tagged(spark, d):
    tagged = table(spark, d, "embeddings").filter(F.arrays_overlap(F.array("label"), F.array(F.lit(0), F.lit(3))))
    return retrieval.dense(tagged, vector_queries(spark, d), 20, 0.2)


#: The question of a benchmark item is also asked as the vector of that number.
FUSED_SQL = f"""{BM25_SQL.replace("{k}", "20")},
{DENSE_SQL.format(k=40, where='').replace('where vec_id % 100 = 0', 'where vec_id in (select item_id from benchmark)').strip()},
branches as (select qid, doc_id, rank from sparse union all select qid, vec_id, rank from dense),
fused as (select qid, doc_id, round(sum(1.0 / ({L.RRF_K} + rank)), 9) as score from branches group by qid, doc_id),
hybrid as (select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from fused) where rank <= 20)"""


def branches(spark, d) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, d, "embeddings").join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("qid"), "embedding")
    vectors = retrieval.dense(table(spark, d, "embeddings"), asked, 40, 0.2).withColumnRenamed("vec_id", "doc_id")
    # Forty rows a question, which several steps read.
    return sparse(spark, d, 20), checkpoint(vectors)


@query(f"with {FUSED_SQL} select qid, doc_id, cast(score as double) as score, rank from hybrid")
def rrf_fusion(spark, d):
    return retrieval.fuse(list(branches(spark, d)), limit=20)


@query(f"with {FUSED_SQL}, s as (select qid, doc_id, 1 as side from sparse where rank <= 10 union all select qid, vec_id, 2 from dense where rank <= 10), k as (select qid, doc_id, sum(side) as sides from s group by qid, doc_id) select qid, count(*) filter (sides = 3) as \"both\", count(*) filter (sides = 1) as only_a, count(*) filter (sides = 2) as only_b from k group by qid")
def branch_overlap(spark, d):
    return retrieval.branch_overlap(*branches(spark, d))


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by md5(left(text, 200)) order by doc_id) as n from documents) where n = 1")
def article_dedup_prefix(spark, d):
    rows = table(spark, d, "documents").select(F.lit(1).alias("qid"), "doc_id", "source", F.md5(F.substring("text", 1, 200).cast("binary")).alias("prefix"), F.col("doc_id").alias("rank"))
    return retrieval.first_per_key(rows, ["prefix"]).select("source", "doc_id")


# --- Cut-offs and evidence ---


def ranked_documents(spark, d, limit: int = 20) -> DataFrame:
    """Sparse hits with the columns that evidence operators take."""
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 40).alias("heading"), F.col("text").alias("content"))
    return retrieval.with_documents(sparse(spark, d, limit), docs).join(questions(spark, d).withColumnRenamed("text", "question"), "qid")


@query(f"""with {BM25_SQL.replace("{k}", "100")},
a as (select qid, doc_id, score, rank, md5(left(text, 200)) as m from sparse join documents using (doc_id)),
b as (select *, row_number() over (partition by qid, m order by score desc, rank) = 1 as f from a),
c as (select *, coalesce(sum(f::int) over (partition by qid order by score desc, rank rows between unbounded preceding and 1 preceding), 0) as n, last_value(case when f then score end ignore nulls) over (partition by qid order by score desc, rank rows between unbounded preceding and 1 preceding) as prev, first_value(score) over (partition by qid order by score desc, rank) as top from b),
e as (select *, max(coalesce(n >= 1 and (score < 0.35 * top or (prev > 0 and score < prev * case when n >= 20 then 0.5 else 0.4 end)), false)::int) over (partition by qid order by score desc, rank rows between unbounded preceding and current row) as stop from c)
select qid, doc_id, score, rank from e where f and stop = 0 and n < 100""")
def score_gap_select(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("content"))
    return ranking.score_gap_select(retrieval.with_documents(sparse(spark, d, 100), docs)).select("qid", "doc_id", "score", "rank")


@query(f"""with {DENSE_SQL.format(k=20, where='')},
a as (select *, row_number() over w as n, first_value(score) over w as top, lag(score) over w as prev, count(*) over (partition by qid) as c from dense window w as (partition by qid order by score desc, rank)),
b as (select *, max(coalesce(n > least(3, c) and (score < 0.4 * top or (prev > 0 and score < 0.5 * prev)), false)::int) over (partition by qid order by score desc, rank rows between unbounded preceding and current row) as stop from a)
select qid, vec_id, score, rank from b where stop = 0 and n <= 5""")
def adaptive_cutoff(spark, d):
    return ranking.adaptive_cutoff(retrieval.dense(table(spark, d, "embeddings"), vector_queries(spark, d), 20, 0.2))


RANKED_SQL = f"""{BM25_SQL.replace("{k}", "{k}")},
r as (select s.qid, s.doc_id, s.rank, s.score, left(d.text, 40) as heading, d.text as content, q.text as question from sparse s join documents d using (doc_id) join q using (qid))"""
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + ")"
STRIP_SQL = r"regexp_replace({}, '^[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g')"


@query(rf"""with {RANKED_SQL.replace("{k}", "20")},
a as (select *, list_filter(regexp_extract_all(lower(question), '[\x{{0B80}}-\x{{0BFF}}]{{2,}}|[a-z0-9]{{3,}}'), lambda t: t not in {STOP_SQL}) as ordered, lower(content || ' ' || heading) as txt, lower(heading) as h from r),
b as (select *, list_distinct(ordered) as terms, list_distinct(regexp_extract_all(txt, '[\x{{0B80}}-\x{{0BFF}}]{{2,}}|[a-z0-9]{{3,}}')) as words from a),
c as (select *, len(list_filter(terms, lambda t: contains(txt, t) or len(list_filter(words, lambda w: least(length(w), length(t)) >= 3 and left(w, greatest(3, floor(least(length(w), length(t)) * 0.6)::int)) = left(t, greatest(3, floor(least(length(w), length(t)) * 0.6)::int)))) > 0)) as matched,
  len(list_filter(range(1, len(ordered)), lambda i: contains(h, ordered[i] || ' ' || ordered[i + 1]))) > 0 as bigram_hit, len(list_filter(terms, lambda t: contains(h, t))) > 0 as term_hit from b),
e as (select *, term_hit or bigram_hit as heading_hit from c where len(terms) = 0 or term_hit or bigram_hit or matched >= greatest(1, least(2, floor(len(terms) * 0.3))))
select qid, doc_id, cast(matched as integer) as matched, heading_hit, bigram_hit, row_number() over (partition by qid order by bigram_hit desc, heading_hit desc, matched desc, rank) as filtered_rank from e""")
def lexical_filter(spark, d):
    return ranking.lexical_filter(ranked_documents(spark, d)).select("qid", "doc_id", "matched", "heading_hit", "bigram_hit", "filtered_rank")


@query(rf"""with {RANKED_SQL.replace("{k}", "20")},
a as (select *, list_filter(regexp_extract_all(lower(question), '[\x{{0B80}}-\x{{0BFF}}a-z0-9]+'), lambda t: length(t) >= 2 and t not in {STOP_SQL}) as t from r),
b as (select *, len(list_filter(list_concat({", ".join(f"list_transform(range(1, greatest(1, len(t) - {n - 2})), lambda i: array_to_string(t[i:i + {n - 1}], ' '))" for n in (4, 3, 2))}), lambda p: contains(lower(heading), p))) > 0 as hit from a),
c as (select *, row_number() over (partition by qid, hit order by rank) as nth, count(*) filter (hit) over (partition by qid) as m from b),
e as (select *, case when hit then if(nth <= 30, 0, 2) else if(nth <= greatest(0, 30 - m), 1, 3) end as bucket from c)
select qid, doc_id, rank, row_number() over (partition by qid order by bucket, rank) as pinned_rank from e""")
def heading_pin(spark, d):
    return ranking.pin_headings(ranked_documents(spark, d)).select("qid", "doc_id", "rank", "pinned_rank")


FACTS_SQL = rf"""{RANKED_SQL.replace("{k}", "20")},
fa as (select *, list_distinct(regexp_extract_all(lower(question), '[\x{{0B80}}-\x{{0BFF}}]{{3,}}|[a-z]{{4,}}')) as keywords from r where rank <= 15),
fb as (select qid, rank, keywords, unnest(string_split_regex(content, '[.।!?]+')) as s, generate_subscripts(string_split_regex(content, '[.।!?]+'), 1) as pos from fa),
fc as (select *, {STRIP_SQL.format('s')} as fact from fb),
fd as (select *, 3 * len(list_filter(keywords, lambda k: contains(lower(fact), k))) as score from fc where length(fact) >= 30),
facts as (select qid, fact_rank, fact, score from (select *, row_number() over (partition by qid order by score desc, rank, pos) as fact_rank from fd where score >= 5) where fact_rank <= 20)"""


@query(f"with {FACTS_SQL} select qid, fact_rank, fact, cast(score as integer) as score from facts")
def key_facts(spark, d):
    return ranking.key_facts(ranked_documents(spark, d))


@query(f"""with {FACTS_SQL}, j as (select qid, {STRIP_SQL.format("string_agg(regexp_replace(fact, '__.*?__', '', 'g'), '. ' order by fact_rank)")} as answer from facts where fact_rank <= 5 group by qid)
select qid, if(regexp_matches(answer, '[.!?।]$'), answer, answer || '.') as answer from j""")
def extractive_answers(spark, d):
    return ranking.extractive_answer(ranking.key_facts(ranked_documents(spark, d)))


def excerpt_sql(most: str) -> str:
    """The best window of ``content`` for ``keywords``, over rows (qid, doc_id, content, keywords, most)."""
    x = f"substr(lower(content), cast(p + 1 as bigint), {most})"
    hits = f"coalesce(list_sum(list_transform(keywords, lambda k: (length({x}) - length(replace({x}, k, ''))) // length(k))), 0)"
    return f"if(length(content) <= {most}, content, substr(content, cast(1 + list_first(list_transform(list_sort(list_transform(generate_series(0, greatest(0, length(content) - {most}), greatest(100, {most} // 10)), lambda p: {{'n': -({hits}), 'p': p}})), lambda z: if(z.n < 0, z.p, 0))) as bigint), {most}))"


@query(f"with {RANKED_SQL.replace("{k}", "5")}, a as (select *, list_distinct(regexp_extract_all(lower(question), '[a-z]{{4,}}')) as keywords from r) select qid, doc_id, {excerpt_sql('400')} as excerpt from a")
def best_excerpt(spark, d):
    words = F.array_distinct(T.matches(F.lower("question"), "[a-z]{4,}"))
    rows = ranked_documents(spark, d, 5).withColumn("_low", F.lower("content")).withColumn("_words", words)
    return rows.select("qid", "doc_id", T.best_excerpt(F.col("content"), F.col("_words"), 400, F.col("_low")).alias("excerpt"))


@query(rf"""with {RANKED_SQL.replace("{k}", "20")},
a as (select *, list_distinct(regexp_extract_all(lower(question), '[\x{{0B80}}-\x{{0BFF}}]{{3,}}|[a-z]{{4,}}')) as keywords, count(*) over (partition by qid) as n, row_number() over (partition by qid order by rank) as i from r where rank <= 15),
b as (select *, greatest(500, 15000 // n) as most from a),
c as (select qid, n, i, 'ஆவணம் ' || i || '/' || n || if(heading <> '', ' — ' || heading, '') || ':' || chr(10) || {excerpt_sql('most')} as part from b)
select qid, '[' || max(n) || ' ஆவணங்கள் — ஒவ்வொன்றின் தகவலையும் பயன்படுத்தவும்]' || chr(10) || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) order by i) as context, max(n) as documents from c group by qid""")
def answer_contexts(spark, d):
    return ranking.contexts(ranked_documents(spark, d))


# --- Evaluation ---

QRELS_SQL = """
qrels as (select q.item_id as qid, l.doc_id, l.quality + l.toxic as gain from benchmark q, labels l where (l.doc_id + q.item_id) % 3 = 0),
runs as (select 'hybrid' as system, qid, rank, doc_id from hybrid union all select 'sparse', qid, rank, doc_id from sparse union all select 'dense', qid, rank, vec_id from dense where rank <= 20),
asked as (select distinct system, item_id as qid from (values ('hybrid'), ('sparse'), ('dense')) s(system), benchmark),
g as (select r.system, r.qid, r.rank, coalesce(x.gain, 0) as gain from runs r left join qrels x on x.qid = r.qid and x.doc_id = r.doc_id),
h as (select *, sum((gain > 0)::int) over (partition by system, qid order by rank) as hits from g),
ideal as (select qid, gain, row_number() over (partition by qid order by gain desc, doc_id) as i from qrels where gain > 0),
best as (select qid, count(*) as relevant, {best} from ideal group by qid),
got as (select system, qid, min(case when gain > 0 then rank end) as f, sum(case when gain > 0 then hits / rank end) as ap, {got} from h group by system, qid),
metrics as (select system, qid, {out}, coalesce(round(1.0 / f, 6), 0) as mrr, coalesce(round(ap / nullif(relevant, 0), 6), 0) as map from asked left join got using (system, qid) left join best using (qid))"""


def metric_sql() -> str:
    worth = lambda place: f"(pow(2, gain) - 1) / log2({place} + 1)"
    cuts = evaluation.CUTS
    best = ", ".join(f"sum(case when i <= {k} then {worth('i')} end) as idcg{k}" for k in cuts)
    got = ", ".join(f"count(*) filter (gain > 0 and rank <= {k}) as n{k}, sum(case when rank <= {k} then {worth('rank')} end) as dcg{k}" for k in cuts)
    out = ", ".join(
        f"coalesce(round(dcg{k} / nullif(idcg{k}, 0), 6), 0) as ndcg_{k}, coalesce(round(n{k} / relevant, 6), 0) as recall_{k}, coalesce(round(n{k} / {k}, 6), 0) as precision_{k}, coalesce((n{k} > 0)::double, 0) as hit_{k}" for k in cuts
    )
    return FUSED_SQL + "," + QRELS_SQL.format(best=best, got=got, out=out)


def runs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rankings, qrels, queries): gains are made from the labels by a fixed rule, as the tables hold none."""
    by_word, by_vector = branches(spark, d)
    fused = retrieval.fuse([by_word, by_vector], limit=20)
    named = lambda df, name: df.filter("rank <= 20").select(F.lit(name).alias("system"), "qid", "rank", F.col("doc_id").alias("doc_key"))
    rankings = named(fused, "hybrid").unionByName(named(by_word, "sparse")).unionByName(named(by_vector, "dense"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.pmod(-F.col("item_id"), F.lit(3)).alias("r"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("doc_key"), (F.col("quality") + F.col("toxic")).alias("gain"), (F.col("doc_id") % 3).alias("r"))
    qrels = labels.join(items, "r").select("qid", "doc_key", "gain")
    systems = spark.createDataFrame([("hybrid",), ("sparse",), ("dense",)], "system string")
    return rankings, qrels, items.select("qid").crossJoin(F.broadcast(systems)).select("system", "qid")


def rounded_metrics(spark, d) -> DataFrame:
    # A row a system and question.
    metrics = checkpoint(evaluation.ranking_metrics(*runs(spark, d)))
    return metrics.select("system", "qid", *(F.round(F.col(f"`{c}`"), 6).alias(c.replace("@", "_")) for c in metrics.columns if c not in ("system", "qid")))


@query(f"with {metric_sql()} select * from metrics")
def ir_metrics(spark, d):
    return rounded_metrics(spark, d)


METRICS = [f"{m}_{k}" for k in evaluation.CUTS for m in ("ndcg", "recall", "precision", "hit")] + ["mrr", "map"]


@query(f"with {metric_sql()} select system, count(*) as queries, {', '.join(f'round(avg({m}), 4) as {m}' for m in METRICS)} from metrics group by system")
def ir_macro_avg(spark, d):
    averages = evaluation.macro_average(rounded_metrics(spark, d))
    return averages.select("system", "queries", *(F.round(m, 4).alias(m) for m in METRICS))


@query(f"with {metric_sql()}, seen as (select qid, doc_id as doc_key, min(rank * 10 + case system when 'hybrid' then 1 when 'dense' then 2 else 3 end) as first_at from runs group by qid, doc_id) select qid, doc_key, place from (select *, row_number() over (partition by qid order by first_at, doc_key) as place from seen) where place <= 40")
def pool_round_robin(spark, d):
    return evaluation.round_robin_pool(runs(spark, d)[0], ["hybrid", "dense", "sparse"])


@query()
def permutation_test(spark, d):
    return evaluation.permutation_tests(rounded_metrics(spark, d), "ndcg_10", "hybrid")


@query()
def rouge_l_chars(spark, d):
    """Every turn of a conversation as an answer, scored whole against the turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(order).alias("before")).filter("before is not null")
    scores = [F.round(f(F.col("before"), F.col("text")), 6).alias(n) for n, f in (("rouge_l", U.rouge_l), ("bleu_1", U.bleu_1), ("bleu_2", U.bleu_2))]
    return turns.select("conv_id", "turn", *scores)


# --- Tagging, vocabulary, fuzzy lookup ---

CATEGORIES = {"the": "the that this", "de": "de la le les", "und": "und der die", "GENERAL": "of to in"}
TFIDF_SQL = f"""
tf as (select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(left(text, 500)), '[\\x{{0B80}}-\\x{{0BFF}}]+|[\\p{{L}}\\p{{N}}_]+')) as term from documents) group by all),
n as (select count(*) as n from documents),
df as (select term, count(*) as df, sum(tf) as total from tf group by term),
kept as (select term, ln((1 + n) / (1 + df)) + 1 as idf from (select * from df, n where df >= 2 and df <= 0.95 * n order by total desc, term limit 5000)),
kw as (select tag, term, count(*) as tf from (values {', '.join(f"('{t}', '{w}')" for t, ws in CATEGORIES.items() for w in ws.split())}) v(tag, term) group by all),
dv as (select id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by id)) as w from tf join kept using (term)),
kv as (select tag, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by tag)) as w from kw join kept using (term)),
sim as (select id, tag, round(sum(dv.w * kv.w), 6) as similarity from dv join kv using (term) group by id, tag),
named as (select *, row_number() over (partition by id order by similarity desc, case tag {' '.join(f"when '{t}' then {i}" for i, t in enumerate(CATEGORIES))} end) as rank from sim where similarity >= 0.15 and tag <> 'GENERAL')
select id, tag, similarity, rank from named where rank <= 3"""


@query("with " + TFIDF_SQL.strip())
def tfidf_classify(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 500).alias("text"))
    vectors, idf = indexing.tfidf_vectors(texts)
    return indexing.tfidf_tags(vectors, idf, CATEGORIES)


def tags_sql(names: dict[str, str]) -> str:
    """Comma-joined names of the categories whose rules fit a title t."""
    cases = []
    for category, (exact, parts) in L.TITLE_RULES.items():
        whole = (*exact, *(L.SERIAL_TITLES if category == "FICTION" else ()))
        tests = [f"t in ({', '.join(repr(x) for x in whole)})"] * bool(whole) + [f"contains(t, '{x}')" for x in parts]
        cases.append(f"case when {' or '.join(tests)} then '{names[category]}' end")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x is not null), ',')"


@query(f"select conv_id, turn, {tags_sql({c: c for c in L.TAXONOMY})} as tags, {tags_sql({c: t for c, (t, _) in L.TAXONOMY.items()})} as tags_tamil from (select conv_id, turn, {STRIP_SQL.format("coalesce(text, '')")} as t from conversations)")
def rule_tags(spark, d):
    titles = table(spark, d, "conversations").select("conv_id", "turn", indexing.rule_tags(F.col("text"), F.lit(True)).alias("t"))
    return titles.select("conv_id", "turn", F.array_join("t", ",").alias("tags"), F.array_join(indexing.tamil_tags(F.col("t")), ",").alias("tags_tamil"))


@query("""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as word from benchmark),
v as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as known from documents)
select w.word, v.known, levenshtein(w.word, v.known) as edits from w join v on left(w.word, 3) = left(v.known, 3) and abs(length(w.word) - length(v.known)) <= 2 where levenshtein(w.word, v.known) <= 1""")
def fuzzy_block_join(spark, d):
    words = catalog.vocabulary(table(spark, d, "benchmark"), "text", "[a-z]{5,}").withColumn("block", F.substring("word", 1, 3))
    known = catalog.vocabulary(table(spark, d, "documents"), "text", "[a-z]{5,}").select(F.col("word").alias("known"), F.substring("word", 1, 3).alias("block"))
    edits = F.levenshtein(F.col("word"), F.col("known"))
    return words.join(known, "block").filter(T.safe_to_correct(F.col("word"), F.col("known"))).select("word", "known", edits.alias("edits")).filter("edits <= 1")


@query()
def ratio_nearest(spark, d):
    """The most similar part name."""
    return catalog.nearest(table(spark, d, "part").select(F.col("p_name").alias("name")), "name", "green steel hammer", 0.0)


@query("""with s as (select doc_id, contains(lower(text), 'the that with') as one, contains(lower(text), 'the') and contains(lower(text), 'that') and contains(lower(text), 'with') as two from documents)
select doc_id, if(one, '1', '2') as stage from s where if((select bool_or(one) from s), one, two)""")
def topic_lookup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"))
    return catalog.by_topic(rows, "the that with").select("doc_id", "stage")


# --- State ---


@query("select sha256(string_agg(line, chr(10) order by line)) as source_hash from (select cast(o_orderkey as varchar) || '|' || cast(o_custkey as varchar) as line from orders)")
def source_hash(spark, d):
    return indexing.source_hash(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("modified")))


SANITIZE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({}), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g'), '["'']', '', 'g'), '={{4,}}', '---', 'g'), '`{{3,}}', '''', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{3,}}', ' ', 'g'), '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"""
HIGH_SQL = "(?i)" + "|".join(f"(?:{p})" for p in L.INJECTION_HIGH).replace("'", "''")
HISTORY_SQL = f"""
ha as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as n from conversations),
hb as (select conv_id, turn, role, {SANITIZE_SQL.format("left(coalesce(text, ''), 5000)")} as text from ha where n <= 20 and role in ('user', 'assistant')),
hc as (select *, row_number() over (partition by conv_id order by turn) as k, role = 'user' and regexp_matches(text, '{HIGH_SQL}') as bad from hb),
walk as (select conv_id, 0 as k, 'user' as want, false as kept from (select distinct conv_id from hc) union all
  select w.conv_id, w.k + 1, if(role = want and not bad, if(want = 'user', 'assistant', 'user'), want), role = want and not bad from walk w join hc h on h.conv_id = w.conv_id and h.k = w.k + 1),
history as (select conv_id, cast(row_number() over (partition by conv_id order by k) - 1 as integer) as position, turn, role, text from walk join hc using (conv_id, k) where kept)"""


@query(f"with recursive {HISTORY_SQL} select * from history")
def history_validate(spark, d):
    return state.valid_history(table(spark, d, "conversations"))


def requests(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id")).alias("email"), F.concat(F.lit("a"), F.col("user_id") % 40).alias("address"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts")).withColumn("ts", F.col("ts") / 1e6)


RATE_SQL = """with recursive r as materialized (select event_id as id, coalesce('u' || user_id, '') as e, coalesce('a' || user_id % 40, '') as a, epoch_us(ts) / 1e6 as ts,
    row_number() over (order by ts, event_id) as n from events),
walk as (select cast(0 as bigint) as n, cast(null as bigint) as id, false as ok, cast([] as struct(e varchar, a varchar, ts double)[]) as log
  union all select n, id, ok, if(ok, list_append(l, {'e': e, 'a': a, 'ts': ts}), l) from (
    select *, len(list_filter(l, lambda x: x.e = e)) < 3 and len(list_filter(l, lambda x: x.a = a)) < 10 as ok from (
      select r.*, list_filter(w.log, lambda x: x.ts > r.ts - 3600) as l from walk w join r on r.n = w.n + 1)))
select id as request_id, ok as allowed from walk where n > 0"""


@query(RATE_SQL)
def rate_limit_exact(spark, d):
    return state.rate_limit(requests(spark, d))


@query("select event_id, count(*) over (partition by user_id order by s range between 3600 preceding and 1 preceding) as recent from (select event_id, user_id, cast(floor(epoch_us(ts) / 1000000) as bigint) as s from events)")
def rate_limit_window(spark, d):
    return state.rate_window(table(spark, d, "events"), "user_id").select("event_id", "recent")


@query("select event_id, coalesce(s - lag(s) over (partition by user_id order by ts, event_id) < 3600, false) as hit from (select event_id, user_id, ts, cast(floor(epoch_us(ts) / 1000000) as bigint) as s from events)")
def ttl_cache_hits(spark, d):
    return state.ttl_hits(table(spark, d, "events"), "user_id").select("event_id", "hit")


LRU_SQL = """with recursive r as materialized (select event_id as id, coalesce(cast(user_id as varchar), '') || ':' || coalesce(event_type, '') as k, epoch_us(ts) / 1e6 as ts,
    cast(floor(epoch_us(ts) / 1e6 / 604800) as bigint) as v, row_number() over (order by ts, event_id) as n from events),
walk as (select cast(0 as bigint) as n, cast(null as bigint) as id, false as hit, cast([] as struct(k varchar, put double)[]) as held, cast(null as bigint) as v
  union all select n, id, hit, list_append(list_filter(l, lambda x: x.k <> k)[-99:], {'k': k, 'put': if(hit, put, ts)}), v from (
    select *, list_filter(l, lambda x: x.k = k)[1].put as put, coalesce(ts - list_filter(l, lambda x: x.k = k)[1].put <= 3600, false) as hit from (
      select r.*, if(r.v <> w.v, [], w.held) as l from walk w join r on r.n = w.n + 1)))
select id as request_id, hit from walk where n > 0"""


@query(LRU_SQL)
def lru_cache_hits(spark, d):
    """One cache of 100 answers over the event log: a user's event type is the question, and the table's version changes every week."""
    key = F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("event_type", F.lit("")))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = table(spark, d, "events").select(F.col("event_id").alias("request_id"), key.alias("key"), seconds.alias("ts"), F.floor(seconds / 604_800).alias("version"))
    return state.cache_hits(events)


@case("select cast(n as integer) as attempt, least(0.5 * pow(2, n), 4.0) as delay from range(6) t(n)")
def retry_delays(spark, d):
    return spark.range(6).select(F.col("id").cast("int").alias("attempt"), state.retry_delay(F.col("id")).alias("delay"))




# --- More scalars, listings and joins ---


@query("select conv_id, turn, md5(left(text, 200)) as prefix_md5, sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) as cache_key from conversations")
def text_digests(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.substring("text", 1, 200).cast("binary")).alias("prefix_md5"), answers.cache_key(F.col("text")).alias("cache_key"))


@query(f"select doc_id, coalesce(h <> '' and not regexp_matches(h, '^\\d+$') and length(h) < 25 and not regexp_matches(h, '^[—–-]'), false) as heading from (select doc_id, {STRIP_SQL.format("split_part(text, '.', 1)")} as h from documents)")
def heading_validity(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("h"))
    return rows.select("doc_id", T.valid_heading(F.col("h")).alias("heading"))


@query("select author, count(*) as articles from (select trim(unnest(string_split(c_name || ', ' || c_mktsegment, ','))) as author from customer) group by author")
def author_cells(spark, d):
    cell = F.concat(F.lit("["), F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit("]"))
    return catalog.author_counts(table(spark, d, "customer").select(cell.alias("author")))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as requests, round(sum(value), 4) as value from events group by all")
def hourly_requests(spark, d):
    from ..streaming.requests import hourly

    rows = hourly(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "requests", F.round("value", 4).alias("value"))


@query("select tag, english, count(doc_id) as articles from (values " + ", ".join(f"('{t}', '{e.replace(chr(39), chr(39) * 2)}', {i})" for i, (t, (_, e)) in enumerate(L.TAXONOMY.items())) + ") v(tag, english, i) left join documents on doc_id % 15 = i and doc_id % 2 = 0 group by all")
def taxonomy_counts(spark, d):
    """Every category with its number of articles, absent ones with 0 (O-091, O-104); documents get a category by their id."""
    tags = F.array(*map(F.lit, L.TAXONOMY))
    points = table(spark, d, "documents").select((F.col("doc_id") % 2).alias("chunk_id"), F.array(F.get(tags, (F.col("doc_id") % 15).cast("int"))).alias("tags"))
    return catalog.tag_counts(points).select("tag", "english", "articles")


@query("select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def unprocessed_keys(spark, d):
    """Orders without an output, by the anti join of normalised keys (O-020, O-093)."""
    path = lambda c: F.concat(F.lit("Order "), c, F.lit(" .json")).alias("path")
    done = table(spark, d, "lineitem").filter("l_quantity > 45").select(path(F.col("l_orderkey")))
    return readers.unprocessed(table(spark, d, "orders").select("o_orderkey", "o_totalprice", path(F.col("o_orderkey"))), done).select("o_orderkey", "o_totalprice")


@query("select doc_id, quality as gain from labels where quality > 0 union all select doc_id, toxic from labels where quality = 0 and toxic > 0")
def merged_judgements(spark, d):
    rows = table(spark, d, "labels").select(F.lit(1).alias("qid"), F.col("doc_id").alias("doc_key"), F.when(F.col("quality") > 0, F.col("quality").cast("string")).otherwise("").alias("human_gain"), F.col("toxic").alias("llm_gain"), F.lit(1).alias("row_no"))
    return evaluation.merged_judgements(rows).select(F.col("doc_key").alias("doc_id"), "gain")


@query(f"""with recursive {HISTORY_SQL},
h as (select conv_id, list({{'role': if(role = 'assistant', 'model', role), 'text': left(text, 15000)}} order by position) as l from history group by conv_id),
c as (select c.conv_id, list_append(coalesce(l, []), {{'role': 'user', 'text': c.text}}) as contents from conversations c left join h using (conv_id) where turn = 0)
select conv_id, cast(len(contents) as integer) as turns, cast(to_json(contents) as varchar) as contents from c""")
def multi_turn_contents(spark, d):
    history = state.valid_history(table(spark, d, "conversations"))
    asked = table(spark, d, "conversations").filter("turn = 0").select("conv_id", F.col("text").alias("question"))
    return state.multi_turn(history, asked).select("conv_id", F.size("contents").alias("turns"), F.to_json("contents").alias("contents"))


@query()
def segmented_articles(spark, d):
    """Every document is a file of its own, whole in its row, without authors and catalogue."""
    authors, titles = (F.expr(f"cast(array() as {t})") for t in ("array<string>", "array<struct<title:string,authors:array<string>>>"))
    files = table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("f"), F.col("doc_id")).alias("source_document"), F.split("text", "\n").alias("lines"), authors.alias("authors"), titles.alias("titles"))
    return segmentation.segmented_files(files).select("source_document", "article_no", "origin", "title", "first_line", "last_line")


@query()
def spelling_corrections(spark, d):
    known = catalog.vocabulary(table(spark, d, "documents"), "text", "[a-z]{5,}")
    asked = catalog.vocabulary(table(spark, d, "benchmark"), "text", "[a-z]{5,}").select(F.col("word").alias("token"))
    return catalog.corrections(asked, known).select("token", "word", F.round("ratio", 6).alias("ratio"))


@query()
def merged_evidence(spark, d):
    """Chunks of the documents that sparse search hits, merged (O-080, O-106)."""
    docs, found = table(spark, d, "documents"), sparse(spark, d, 5)
    # Titles are ids, so only the chunks of hit documents can be asked for.
    held = checkpoint(retrieval.with_documents(found.select("doc_id").distinct(), docs.select("doc_id", "source", "lang", "text")))
    chunks = indexing.chunk_rows(held, ["doc_id", "source", "lang"], "text")
    points = chunks.select(F.lit("v").alias("volume"), F.col("lang").alias("doc_id"), F.col("source").alias("doc_issue"), F.col("doc_id").cast("string").alias("title"), "chunk_id", "content", F.lit("article").alias("type"))
    hits = found.join(held.select("doc_id", "source", "lang"), "doc_id").select("qid", F.lit("v").alias("volume"), F.col("lang").alias("doc_id"), F.col("source").alias("doc_issue"), F.col("doc_id").cast("string").alias("title"), "score")
    return retrieval.merge_chunks(hits, points).select("qid", F.col("title").alias("doc_key"), "score", "chunk_count", "word_count")


CLIENT_COLUMNS = ("client_id", "source", "segment", "city", "balance", "changed_at")
VERSIONS_SQL = """with first_rows as (
  select client_id, source, segment, city, balance from (
    select *, row_number() over (partition by client_id order by updated_at desc nulls last, source desc nulls last,
      segment desc nulls last, city desc nulls last, balance desc nulls last) as k from clients) where k = 1),
last_changes as (
  select * from (select *, row_number() over (partition by client_id order by seq desc nulls last, change_id desc nulls last) as k
    from client_changes) where k = 1),
changed as (select client_id, source, segment, city, balance from last_changes where op is distinct from 'D'),
gone as (select client_id from last_changes where op = 'D'),
second as (
  select * from changed union all
  select * from first_rows f where not exists (select 1 from changed c where c.client_id is not distinct from f.client_id)),
third as (select * from second s where not exists (select 1 from gone g where g.client_id is not distinct from s.client_id))
select 1 as version, * from first_rows union all select 2, * from second union all select 3, * from third
union all select 4, * from first_rows"""


@query(VERSIONS_SQL)
def client_versions(spark, d):
    """Clients saved, upserted with their last changes, without the deleted ones, and restored: the rows of all four versions (O-032, O-034, O-043)."""
    clients = table(spark, d, "clients").withColumnRenamed("updated_at", "changed_at").select(*CLIENT_COLUMNS)
    rows = table(spark, d, "client_changes").withColumnRenamed("valid_at", "changed_at")
    last = rows.groupBy("client_id").agg(F.max(F.struct("seq", "change_id", "op", *CLIENT_COLUMNS[1:])).alias("last")).select("client_id", "last.*")
    kept = versions.VersionedTable(spark, scratch(spark, "clients") + "/table", ["client_id"])
    first = kept.save(clients, ["changed_at"], rows_per_bucket=100_000)
    kept.upsert(last.filter(~F.col("op").eqNullSafe("D")))
    kept.remove(last.filter("op = 'D'"))
    kept.restore(first)
    found = [kept.read(v).select(F.lit(v).alias("version"), *CLIENT_COLUMNS[:-1]) for v in kept.versions()]
    return functools.reduce(DataFrame.unionAll, found)


@query()
def question_corrections(spark, d):
    """Clients' names as questions, corrected by the words of regions and nations, of the names of the first records, of vendors and of cities (O-190)."""
    clients = table(spark, d, "clients")
    texts = lambda rows, c: rows.select(F.lower(c).alias("text"))
    known = texts(table(spark, d, "region"), "r_name").unionByName(texts(table(spark, d, "nation"), "n_name"))
    titles = texts(clients.filter("client_id = master_id"), "name")
    names = clients.select("client_id", F.lower("name").alias("name"))
    asked = names.select(F.col("name").alias("question"))
    vendors, cities = texts(table(spark, d, "vendors"), "name"), texts(clients, "city")
    found = spelling.corrected_questions(asked, known, titles, vendors, cities, r"[\p{L}]+")
    return names.join(found, names["name"].eqNullSafe(found["question"])).select("client_id", "question", "corrected")
