"""Registered queries over small tables made here, for semantics that the driver's tables hold no text for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, catalog, evaluation, issues, understanding
from .registry import STRIP_SQL, case, query, table


def quoted(value) -> str:
    return "null" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A SQL table of rows; ``columns`` are names with types."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    kind = {"string": "varchar", "int": "integer", "long": "bigint", "double": "double"}
    cells = [", ".join(f"cast({quoted(v)} as {kind[k]})" for v, k in zip(row, kinds, strict=True)) for row in rows]
    return "(values " + ", ".join(f"({c})" for c in cells) + f") v({', '.join(names)})"


def lines_of(files: dict[str, str]) -> list[tuple]:
    return [(name, i, line) for name, text in files.items() for i, line in enumerate(text.split("\n"))]


# --- Questions ---

QUESTIONS = [
    "எழுத்தாளர்கள் பட்டியல்", "இந்த கதை யார் எழுதினார்", "மு. அருணன் எழுதிய கதைகள்", "கதைச் சுருக்கம் தருக", "who wrote this", "எந்த ஆண்டு வெளியானது",
    "works by கவி. மாலன்", "எத்தனை இதழ் உள்ளன", "மலர் 5 இதழ் 7", "மூன்றாவது மலர் இரண்டாவது இதழ்", "start year?", "plain words", "பாரதம் பற்றிய படைப்புகள்",
    "பொய்யார் எழுதிய நூல்", "total issues please", "பகுதியில் எழுதியவர்கள் யார்", "மலர்கள் எந்த இதழ்", "", "articles by அ. ரகு படைப்புகள் யாவை",
]


def has_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def route_sql() -> str:
    """The order of tests of a question, over rows (i, t)."""
    n, who = understanding, understanding.WHO
    starts = " or ".join(f"regexp_matches(q, '(^| )' || regexp_escape({quoted(p)}))" for p in n.TOPIC_AUTHOR if p.startswith(who))
    topic = has_sql("q", tuple(p for p in n.TOPIC_AUTHOR if not p.startswith(who))) + f" or {starts}"
    author = f"regexp_matches(q, '{n.INITIALS}') and " + has_sql("q", n.AUTHOR_ACTION)
    words = [(w, i) for names in (n.ORDINALS, n.CARDINALS) for i, w in enumerate(names, 1)]
    table_sql = "map {" + ", ".join(f"{quoted(w)}: {i}" for w, i in words) + "}"
    any_number = "(\\d+|" + "|".join(sorted((w for w, _ in words), key=len, reverse=True)) + ")"
    ordinal = "(" + "|".join(n.ORDINALS) + ")"

    def number(noun: str) -> str:
        forms = (ordinal + "\\s*" + noun, noun + "\\s*[-:]?\\s*" + any_number, any_number + "\\s*" + noun)
        found = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{f}', 1), '')" for f in forms) + ")"
        return f"coalesce({table_sql}[{found}], try_cast({found} as integer))"

    return f"""kinds as (select *, {number('மலர்')} as volume, {number('இதழ்')} as issue, case when {has_sql('q', n.YEAR_WORDS)} or {has_sql('q', n.CONTENT_WORDS)} then 'none'
  when {has_sql('q', n.LIST_AUTHORS)} then 'list_all_authors' when {topic} then 'topic_author' when {author} then 'author_topics'
  when {has_sql('q', n.TOPIC_CONTENT)} or {has_sql('q', n.ISSUE_OF)} then 'topic_author' else 'none' end as kind from (select *, trim(lower(t)) as q from asked)),
routes as (select *, case when {has_sql('lower(t)', n.START_YEAR)} then 'start_year' when {has_sql('lower(t)', n.ISSUE_COUNT)} then 'issue_count' when volume is not null and issue is not null then 'contents'
  when kind <> 'none' then kind else 'vector_search' end as route from kinds)"""


def numbered(texts: list) -> list[tuple]:
    return list(enumerate(texts))


@case(f"with asked as (select * from {values(numbered(QUESTIONS), 'i int, t string')}), {route_sql()} select i, kind, route, volume, issue from routes")
def question_cases(spark, d):
    t = F.col("t")
    numbers = understanding.issue_numbers(t)
    df = spark.createDataFrame(numbered(QUESTIONS), "i int, t string")
    return df.select("i", understanding.query_type(t).alias("kind"), understanding.route(t).alias("route"), numbers["volume"].alias("volume"), numbers["issue"].alias("issue"))


@query(f"with asked as (select conv_id, turn, text as t from conversations where role = 'user'), {route_sql()} select conv_id, turn, route from routes")
def question_routes(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return understanding.routed(rows).select("conv_id", "turn", "route")


# --- Answers ---

LINES = ["தொடர் கதை", " சிறுவர் ", "--- Page 51 (scan_51.png) ---", "-- page 2 --", "சிறுவர் கதை", "", "a\nஅரங்கம்\nb\n--- Page 3 x ---", "- Page 3 -", "?!", "க", "_", None]


@case(
    f"""with a as (select * from {values(numbered(LINES), 'i int, t string')}), s as (select *, {STRIP_SQL.format('t')} as b from a),
p as (select i, string_split(t, chr(10)) as parts from a),
k as (select i, list_filter(parts, lambda x: not ({STRIP_SQL.format('x')} in ({', '.join(map(quoted, answers.SKIP_LINES))}) or regexp_matches({STRIP_SQL.format('x')}, '{answers.PAGE_MARKER}'))) as kept from p)
select s.i, coalesce(b in ({', '.join(map(quoted, answers.SKIP_LINES))}) or regexp_matches(b, '{answers.PAGE_MARKER}'), false) as skipped, {STRIP_SQL.format("array_to_string(kept, chr(10))")} as rest, coalesce(regexp_matches(t, '[\\p{{L}}\\p{{N}}_\\x{{0B80}}-\\x{{0BFF}}]'), false) as meaningful from s join k using (i)"""
)
def skipped_lines(spark, d):
    t = F.col("t")
    df = spark.createDataFrame(numbered(LINES), "i int, t string")
    return df.select("i", answers.is_skip_line(t).alias("skipped"), answers.without_skip_lines(t).alias("rest"), answers.is_meaningful(t).alias("meaningful"))


GOOD = "இது ஒரு நல்ல விடை. It is a plain sentence that says something useful."
ANSWERS = [
    GOOD, "\n".join([GOOD] * 4), "\n".join([GOOD] * 4 + ["சொல் 0 4 0", "மேலும் 1 2 3"]), "\n".join(["சொல் 0 4 0"] + [GOOD] * 4), "\n".join([GOOD] * 3 + ["", "பெயர் — மதிப்பு"]),
    GOOD + "\n" + GOOD + "\n" + "x" * 301, "\n".join([GOOD] * 4 + ["அ ஆ 1 2 3 இ ஈ 4 5 6"]), "", "ab\n" * 90 + "சொல் 1 2 3\n" + GOOD,
]
GARBAGE_SQL = " or ".join(f"regexp_matches(line, '{p}')" for p in answers.GARBAGE_LINES)


@case(f"""with a as (select * from {values(numbered(ANSWERS), 'i int, t string')}),
l as (select i, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from a),
o as (select *, sum(length(line) + 1) over (partition by i order by k) as upto, {GARBAGE_SQL} as bad from l),
g as (select *, coalesce(max(case when not bad and trim(line) <> '' then upto end) over (partition by i order by k rows between unbounded preceding and 1 preceding), 0) as good from o),
f as (select i, arg_min(good, k) as cut from g where bad and good > 0.3 * length(t) and length(t) >= 200 group by i)
select a.i, cast(coalesce(cut, -1) as integer) as cut_at, if(cut is null, t, {STRIP_SQL.format('left(t, cast(cut as bigint))')}) as answer from a left join f using (i)""")
def garbage_tails(spark, d):
    df = spark.createDataFrame(numbered(ANSWERS), "i int, t string")
    return df.select("i", answers.garbage_at(F.col("t")).alias("cut_at"), answers.without_garbage(F.col("t")).alias("answer"))


EVIDENCE = [
    (1, 1, "what happened in 1951", "The year 1951 was long", "h", "3", "v"), (2, 1, "what happened in 1951", "The year 1950 was long", "h", "3", "v"),
    (3, 1, "சுராதாவின் கவிதை", "சுராதா எழுதினார்", "h", "3", "v"), (4, 1, "கல்வெட்டு", "வேறு சொல்", "h", "3", "v"), (5, 1, "?? 12", "x", "h", "3", "v"),
    (6, 11, "hidden words", "hidden words", "h", "3", "v"), (6, 1, "hidden words", "nothing", "h", "3", "v"), (7, 2, "Temple stone", "x", "the TEMPLE", "3", "v"),
]


@case(rf"""with e as (select * from {values(EVIDENCE, 'qid int, rank int, question string, content string, heading string, doc_issue string, volume string')} where rank <= 10),
b as (select qid, first(question) as question, lower(string_agg(concat_ws(' ', content, heading, doc_issue, volume, 'an author'), ' ' order by rank)) as body from e group by qid),
t as (select *, regexp_extract_all(question, '\b(19\d{{2}}|20\d{{2}})\b', 1) as years, regexp_extract_all(question, '[\x{{0B80}}-\x{{0BFF}}]{{2,}}') as tamil, regexp_extract_all(lower(question), '[a-z]{{3,}}') as english, regexp_extract_all(body, '[\x{{0B80}}-\x{{0BFF}}]{{2,}}') as words from b)
select qid, case when len(years) > 0 then len(list_filter(years, lambda y: contains(body, y))) > 0 when len(tamil) + len(english) = 0 then true
  else len(list_filter(english, lambda x: contains(body, x))) > 0 or len(list_filter(tamil, lambda x: contains(body, x) or len(list_filter(words, lambda w: least(length(w), length(x)) >= 3 and left(w, greatest(3, floor(least(length(w), length(x)) * 0.6)::int)) = left(x, greatest(3, floor(least(length(w), length(x)) * 0.6)::int)))) > 0)) > 0 end as relevant from t""".replace("\\\\", "\\"))
def context_relevance(spark, d):
    df = spark.createDataFrame(EVIDENCE, "qid int, rank int, question string, content string, heading string, doc_issue string, volume string")
    return answers.relevant(df.withColumn("author_name", F.lit("An author")))


@query("""with s as (select item_id as qid, row_number() over (partition by item_id order by d.n_chars / 7.0 desc, source || '-' || doc_id) as i, source, lang, doc_id, d.text, d.n_chars from benchmark join (select *, row_number() over (order by doc_id) - 1 as r from documents) d on d.r // 3 = item_id),
p as (select qid, count(*) as n, string_agg('ஆதாரம் ' || i || chr(10) || 'இதழ்: ' || source || ' • மலர்: ' || lang || ' • தலைப்பு: ' || source || '-' || doc_id || chr(10) || 'சொற்கள்: ' || n_chars || ' | பொருத்தம்: ' || printf('%.3f', n_chars / 7.0) || chr(10) || chr(10) || text || chr(10), chr(10) order by i) as parts from s group by qid)
select item_id as qid, 'பதில்:' || chr(10) || text || chr(10) || coalesce(chr(10) || chr(10) || 'ஆதாரங்கள் (' || n || ' ஆவணங்கள்):' || chr(10) || chr(10) || parts, '') as shown from benchmark left join p on p.qid = item_id""")
def answer_blocks(spark, d):
    from ..functions.numbering import numbered as counted

    docs = counted(table(spark, d, "documents"), [F.col("doc_id")], "r")
    merged = docs.select(F.floor((F.col("r") - 1) / 3).alias("qid"), F.col("lang").alias("volume"), F.concat_ws("-", "source", "doc_id").alias("title"), F.col("source").alias("doc_issue"), F.col("text").alias("content"), F.col("n_chars").alias("word_count"), F.lit(1).alias("chunk_count"), (F.col("n_chars") / 7).alias("score"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"))
    return answers.answer_block(asked, answers.source_rows(merged))


@query("select c_nationkey as nation, count(*) as articles, md5(string_agg(i || '. தலைப்பு: ' || c_name || ' | ஆசிரியர்: ' || c_mktsegment || coalesce(' | ஆண்டு: ' || year, '') || ' | இதழ்: ' || c_nationkey, chr(10) order by i)) as listing_md5 from (select *, case when c_custkey % 4 > 0 then c_custkey % 9 + 1947 end as year, row_number() over (partition by c_nationkey order by coalesce(case when c_custkey % 4 > 0 then c_custkey % 9 + 1947 end, 9999), c_name) as i from customer) group by 1")
def article_listings(spark, d):
    year = F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 9 + 1947)
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), year.alias("year"), F.col("c_nationkey").alias("issue"))
    listed = answers.listed_articles(rows, "nation", [F.coalesce("year", F.lit(9999)), F.col("title")])
    return listed.select("nation", "articles", F.md5(F.col("listing").cast("binary")).alias("listing_md5"))


# --- Issues ---

HEADERS = {
    "a": "x\nமலர் : 05\nஇதழ் — 12 1951\nமலர் 9", "b": "பொங்கல் மலர் 1948", "c": "மலர் 3\nஎதுவும் இல்லை", "d": "இதழ் 4 மலர் 2", "e": "\n" * 60 + "மலர் 7\nஇதழ் 8", "f": "1950 மலர்- 1\n\nஇதழ்2",
    "g": "\n" * 240 + "மலர் 6\nஇதழ் 1", "h": "none",
}
HEADER_LINES = lines_of(HEADERS)
HEADER_TABLE = values(HEADER_LINES, "source_document string, line_no int, line string")


@case(rf"""with l as (select * from {HEADER_TABLE}), t as (select source_document, string_agg(line, chr(10) order by line_no) as t from l where line_no < 50 group by 1),
n as (select *, regexp_matches(t, 'பொங்கல்\s*மலர்') as f, cast(try_cast(nullif(regexp_extract(t, 'மலர்\s*[:—\-]?\s*(\d+)', 1), '') as bigint) as varchar) as v, cast(try_cast(nullif(regexp_extract(t, 'இதழ்\s*[:—\-]?\s*(\d+)', 1), '') as bigint) as varchar) as i, nullif(regexp_extract(t, '((?:19|20)\d{{2}})', 1), '') as y from t),
b as (select source_document, if(f, 'பொங்கல்', v) as v, if(f, 'பொங்கல் மலர்', i) as i, y from n)
select source_document, if(v is not null and i is not null, v, null) as volume, if(v is not null and i is not null, i, null) as issue, if(v is not null and i is not null, y, null) as year from b""".replace("\\\\", "\\"))
def header_numbers(spark, d):
    return issues.header_numbers(spark.createDataFrame(HEADER_LINES, "source_document string, line_no int, line string"))


@case(rf"""with l as (select *, max(line_no) over (partition by source_document) as top from {HEADER_TABLE}),
a as (select *, case when line_no < 150 then 0 when line_no > top - 50 then 1 end as area, nullif(regexp_extract(line, 'மலர்\s*[:—\-]?\s*(\d{{1,3}})', 1), '') as v, nullif(regexp_extract(line, 'இதழ்\s*[:—\-]?\s*(\d{{1,3}})', 1), '') as i from l)
select source_document, coalesce(arg_min(v, area * 1000 + line_no) filter (v is not null), 'NA') as doc_id, coalesce(arg_min(i, area * 1000 + line_no) filter (i is not null), 'NA') as doc_issue from a where area is not null group by 1""".replace("\\\\", "\\"))
def header_lines(spark, d):
    return issues.header_lines(spark.createDataFrame(HEADER_LINES, "source_document string, line_no int, line string"))


FILES = [("f1", "1", "7"), ("f2", "1", "பொங்கல்"), ("f3", "2", "99"), ("f4", "1.0", "7.0")]
ROWS = [("1", "7", "A"), ("1.0", "7.0", "B"), ("1", "பொங்கல் மலர் ", "C"), ("2", "3", "D"), ("1", None, "E")]


@case(rf"""with f as (select source_document, regexp_replace(trim(volume), '^(-?\d+)\.0+$', '\1') as v, regexp_replace(trim(issue), '^(-?\d+)\.0+$', '\1') as i from {values(FILES, 'source_document string, volume string, issue string')}),
c as (select *, regexp_replace(trim(volume), '^(-?\d+)\.0+$', '\1') as v, trim(regexp_replace(trim(coalesce(issue, '')), '^(-?\d+)\.0+$', '\1')) as i from {values(ROWS, 'volume string, issue string, title string')}),
e as (select source_document, title, 'exact' as matched from f join c on f.v = c.v and f.i = c.i),
s as (select source_document, title, 'similar' as matched from f join c on f.v = c.v and (contains(c.i, f.i) or contains(f.i, c.i)) where source_document not in (select source_document from e))
select * from e union all select * from s""".replace("\\\\", "\\"))
def catalogue_rows(spark, d):
    files = spark.createDataFrame(FILES, "source_document string, volume string, issue string")
    rows = spark.createDataFrame(ROWS, "volume string, issue string, title string")
    return issues.catalogue_rows(files, rows).select("source_document", "title", "matched")


@query("select o_orderkey, coalesce(a, []) as shared from orders left join (select l_orderkey, arg_min([l_linestatus, l_returnflag], l_extendedprice) as a from lineitem where l_linenumber > 1 group by 1) on l_orderkey = o_orderkey".replace("coalesce(a, []) as shared", "array_to_string(coalesce(a, []), ',') as shared"))
def shared_authors(spark, d):
    """Order lines stand for files, orders for issues; a first line has no authors."""
    names = F.when(F.col("l_linenumber") > 1, F.array("l_linestatus", "l_returnflag")).otherwise(F.expr("cast(array() as array<string>)"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("1").alias("doc_issue"), names.alias("authors"), F.col("l_extendedprice").alias("file_order"))
    articles = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("1").alias("doc_issue"))
    return issues.shared_authors(articles, files).select(F.col("doc_id").alias("o_orderkey"), F.array_join("shared", ",").alias("shared"))


@query("select doc_id, row_number() over (partition by doc_id order by position, author) as place, author from (select l_orderkey as doc_id, arg_min(l_returnflag, l_linenumber) as author, min(l_linenumber) as position from lineitem group by l_orderkey, lower(replace(replace(l_returnflag, ' ', ''), '.', '')))")
def distinct_authors(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("1").alias("doc_issue"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("author"))
    return issues.distinct_authors(rows).select("doc_id", F.col("place").cast("bigint").alias("place"), "author")


CATALOGUE = [("T", "[A, B]", "1950.0", "7", "3", "x"), (None, "NA", "unknown", "PONGAL", None, "4.0"), ("U", "[C]", None, None, "12", "-2")]


@case(f"""select coalesce(title, '') as title, case author when 'NA' then 'NA' else replace(replace(author, '[', ''), ']', '') end as author, {', '.join(f"coalesce(cast(try_cast(try_cast({c} as double) as bigint) as varchar), {c}) as {c}" for c in ('year', 'serial', 'order_no'))}, issue from {values(CATALOGUE, 'title string, author string, year string, issue string, serial string, order_no string')}""")
def article_projection(spark, d):
    return issues.article_projection(spark.createDataFrame(CATALOGUE, "title string, author string, year string, issue string, serial string, order_no string"))


KEYS = ["covers/Vol1.png", "covers/x", "a.b/c.JPG", "https://drive.example/file/d/abc-1/view", "/d/x", None]


@case(f"""select i, case when contains(t, '.') then t || coalesce(',' || array_to_string(list_transform(list_filter(['jpg', 'png', 'jpeg'], lambda s: s <> lower(regexp_extract(t, '\\.([^.]*)$', 1))), lambda s: regexp_replace(t, '[^.]*$', '') || s), ','), '') else t end as candidates, nullif(regexp_extract(t, '/d/([^/]+)', 1), '') as drive, coalesce(nullif(trim(split_part(coalesce(t, ''), ',', 1)), ''), 'peer') as address, trim(translate(t, '[]"' || chr(39), '')) as plain from {values(numbered(KEYS), 'i int, t string')}""")
def key_cases(spark, d):
    t = F.col("t")
    df = spark.createDataFrame(numbered(KEYS), "i int, t string")
    return df.select("i", F.array_join(issues.key_candidates(t), ",").alias("candidates"), issues.drive_id(t).alias("drive"), issues.client_address(t, F.lit("peer")).alias("address"), issues.without_brackets(t).alias("plain"))


@query("select page_id, 'covers/' || page_id % 8 || '/' || page_id % 12 || '-' || coalesce(page_id % 5 + 1947, 0) || '.jpg' as key from pages")
def issue_keys(spark, d):
    rows = table(spark, d, "pages").select("page_id", (F.col("page_id") % 8).alias("volume"), (F.col("page_id") % 12).alias("issue"), (F.col("page_id") % 5 + 1947).alias("year"))
    return issues.keys_of(rows, "covers/{volume}/", "{issue}-{year}.jpg").select("page_id", "key")


# --- Catalogue ---

TITLES = ["வேண்டாத ஆசை கதை", "பாரதியின் பாடல்கள்", "Old title one", "மே தின சிறப்பு மலர் கட்டுரை", "சிலப்பதிகாரக் காட்சிகள்", "கல்வி, கலை; அரசியல் நூல்"]
TOPICS = {"வேண்டாத ஆசை": "1", "one old": "2", "கல்வி கலை அரசியல் xyz": "2b", "சிலப்பதிகாரக் அது": "3", "old titla": "4", "zzzz": None}


@case(f"select * from (values {', '.join(f'({quoted(t)}, {quoted(s)})' for t, s in TOPICS.items() if s)}) v(topic, stage)")
def topic_cases(spark, d):
    """The stage that finds each topic."""
    rows = spark.createDataFrame([(t,) for t in TITLES], "title string")
    out = None
    for topic in TOPICS:
        part = catalog.by_topic(rows, topic).select(F.lit(topic).alias("topic"), "stage").distinct()
        out = part if out is None else out.unionByName(part)
    return out


AUTHORS = [
    ("வரதராசன்", "[டாக்டர் மு. வரதராசன், B]", True), ("கலைஞர்", "கருணாநிதி", True), ("கருணாநிதி", "கருணாநிதிxyz", False), ("பாரதிதாசன்", "[X, பாரதிதாசன்]", True),
    ("சுரதா", "கம்பன்", False), ("மு. வரதராசனார்கள்", "[B, மு. வரதராசனாரகள், C]", True), ("A", "NA", False), ("கல்வி", "கல்வீ", True),
]


@case(f"select i, m as matches from (values {', '.join(f'({i}, {str(m).lower()})' for i, (_, _, m) in enumerate(AUTHORS))}) v(i, m)")
def author_cases(spark, d):
    """Whether a name fits a cell, by any step of the match (O-150)."""
    out = None
    for i, (name, cell, _) in enumerate(AUTHORS):
        df = spark.createDataFrame([(i, cell)], "i int, cell string")
        part = df.select("i", catalog.author_matches(name, F.col("cell")).alias("matches"))
        out = part if out is None else out.unionByName(part)
    return out


# --- Evaluation ---


@query("""with s as (select c.conv_id as id, min(case when role = 'user' then text end) as q, min(case when role = 'assistant' then text end) as a from conversations c group by 1)
select count(*) as total, count(*) filter (trim(coalesce(q, '')) <> '' and trim(coalesce(a, '')) <> '') as evaluated, count(*) - count(*) filter (trim(coalesce(q, '')) <> '' and trim(coalesce(a, '')) <> '') as skipped,
  round(avg(1.0 / (1 + length(a))) filter (trim(coalesce(q, '')) <> '' and trim(coalesce(a, '')) <> ''), 6) as avg_similarity from s""")
def evaluation_report(spark, d):
    rows = table(spark, d, "conversations")
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("text")))
    samples = rows.groupBy(F.col("conv_id").alias("id")).agg(of("user").alias("human_answer"), of("assistant").alias("llm_answer")).withColumns({"question": F.col("human_answer"), "category": F.lit("x")})
    scored = evaluation.evaluated(samples, lambda human, answer: 1 / (1 + F.length(answer)))
    return evaluation.report(samples, scored).select("total", "evaluated", "skipped", F.round("avg_similarity", 6).alias("avg_similarity"))


@query("""with p as (select trim(lang) || ' || ' || trim(source) || ' || ' || (doc_id % 50) as doc_key, doc_id, text, if(doc_id % 3 = 0, '', source) as author from documents)
select doc_key, coalesce(arg_min(author, doc_id) filter (author <> ''), '') as author, md5(left(string_agg(text, ' ' order by doc_id), 900)) as snippet_md5 from p group by doc_key""")
def article_snippets(spark, d):
    docs = table(spark, d, "documents")
    points = docs.select(F.lit("article").alias("type"), F.col("lang").alias("volume"), F.col("source").alias("doc_issue"), (F.col("doc_id") % 50).alias("title"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("author"))
    return evaluation.article_snippets(points).select("doc_key", "author", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))

