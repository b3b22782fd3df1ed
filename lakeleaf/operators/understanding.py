"""Question routing, entities, file names, contents lines and answer clean-up.

Rules over one question are columns, so a table of questions is routed in one
pass.  Names of a publication or of its authors are the caller's word lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# --- Fixed values: they must equal those of the semantics this engine implements.  Phrases with the publication's name are the caller's. ---

YEAR_WORDS = ("எந்த ஆண்டு", "ஆண்டு", "வெளியான ஆண்டு")
CONTENT_WORDS = (
    "கருத்து", "சுருக்கம்", "சுருக்கமாக", "கதைச் சுருக்கம்", "கதை சுருக்கம்", "உள்ளடக்கம்", "பொருள்", "விளக்கம்", "விளக்குக", "அர்த்தம்",
    "காட்டு", "காட்டுக", "படிக்க", "முழு கதை", "முழு கட்டுரை", "முழு கவிதை", "theme", "summary", "meaning", "explain", "describe", "content",
    "full text", "show", "அரசியல் சூழல்", "சமூக சூழல்", "பொருளாதார சூழல்", "இலக்கிய சூழல்", "காலகட்டத்தின்", "காலகட்டம்", "வைத்து",
    "கண்ணோட்டம்", "போக்குகள்", "ஆய்வு", "ஒப்பீடு", "தாக்கம்", "பார்வை", "கோணம்", "நோக்கில்", "அடிப்படையில்", "மூலம் அறிய", "மூலம் புரிய",
    "கூறு", "விரிவாக", "விரிவாகக் கூறு", "ஆராய்", "எதிரொலி", "பிரதிபலிக்கிறது", "சித்தரிக்கிறது", "வெளிப்படுகிறது", "விவாதி", "பகுப்பாய்வு",
    "ஆய்வு செய்", "விளக்கம் தருக", "கருத்துகள்", "கருத்துக்கள்", "கருத்தியல்", "சிறப்பம்சங்கள்", "முக்கியத்துவம்", "பங்களிப்பு என்ன", "எவ்வாறு",
    "எப்படி", "ஏன்", "discuss", "analyze", "analyse", "analysis", "elaborate", "context", "significance", "impact", "perspective", "overview",
    "insights", "based on", "using the",
)
LIST_AUTHORS = (
    "எழுத்தாளர்கள் யார்", "ஆசிரியர்கள் யார்", "எழுத்தாளர்கள் பட்டியல்", "எழுத்தாளர்களின் பட்டியல்", "ஆசிரியர்கள் பட்டியல்", "ஆசிரியர்களின் பட்டியல்",
    "அனைத்து எழுத்தாளர்கள்", "அனைத்து ஆசிரியர்கள்", "எழுதியவர்கள்", "எழுதிய ஆசிரியர்கள்", "படைப்பாளிகள் பட்டியல்", "படைப்பாளர்கள் பட்டியல்",
    "கவிஞர்கள் பட்டியல்", "கதாசிரியர்கள் பட்டியல்", "பங்களிப்பாளர்கள்", "பங்களிப்பாளர் பட்டியல்", "இதழில் எழுதியவர்கள்", "who are the authors",
    "list all authors", "list authors", "all writers", "list writers", "list contributors", "contributors list", "who contributed",
    "all contributors",
)
TOPIC_AUTHOR = (
    "யார் எழுதிய", "யார் எழுதினார்", "யார் எழுதியது", "யார் எழுதியவர்", "யார் இயற்றியவர்", "எழுதியவர் யார்", "எழுதியது யார்",
    "எழுதியவத் யார்", "யார் படைத்தார்", "படைத்தவர் யார்", "ஆசிரியர் யார்", "எழுத்தாளர் யார்", "ஆசிரியர்?", "அசிரியர் யார்",
    "கட்டுரையின் ஆசிரியர்", "கதையின் ஆசிரியர்", "கவிதையின் ஆசிரியர்", "பாடலின் ஆசிரியர்", "தொடரின் ஆசிரியர்", "நாவலின் ஆசிரியர்",
    "தலைப்பின் ஆசிரியர்", "படைப்பின் ஆசிரியர்", "பகுதியின் ஆசிரியர்", "பகுதி ஆசிரியர்", "நூலின் ஆசிரியர்", "நூலை எழுதியவர்",
    "பாடியவரின் பெயர்", "பாடியவர் யார்", "பாடியவர் பெயர்", "இயற்றியவர் யார்", "இயற்றியவர் பெயர்", "இயற்றியவரின் பெயர்", "இயற்றியவர் யாவர்",
    "இயற்றியவர் எவர்", "இசையமைத்தவர்", "இசையமைத்தவர் யார்", "எழுதியவரின் பெயர்", "எழுதியவர்", "எழுதியவரின்", "ஆசிரியரின் பெயர்",
    "ஆசிரியரின் பெயர் என்ன", "எழுத்தாளரின் பெயர்", "எழுத்தாளரின் பெயர் என்ன", "படைத்தவரின் பெயர்", "படைத்தவரின் பெயர் என்ன",
    "இயற்றியவரின் பெயர் என்ன", "பாடியவரின் பெயர் என்ன", "யார் இந்த கதை எழுதினார்", "யார் இந்த கவிதை எழுதினார்",
    "யார் இந்த கட்டுரை எழுதினார்", "பகுதியை எழுதியவர்", "பகுதியை இயற்றியவர்", "நெடுவரிசையின் ஆசிரியர்", "நெடுவரிசை ஆசிரியர்",
    "தொடரை எழுதியவர்", "தொடரை இயற்றியவர்", "எனும் பகுதியில் எழுதிய ஆசிரியர்", "என்னும் பகுதியில் எழுதிய ஆசிரியர்",
    "பகுதியில் எழுதிய ஆசிரியர்", "பகுதியில் எழுதியவர்களைப் பட்டியலிடுக", "பகுதியில் எழுதியவர்கள்", "பகுதியில் எழுதியவர் பெயர்",
    "பகுதியில் எழுதிய எழுத்தாளர்", "பகுதியில் எழுதிய ஆசிரியர் பெயர்", "பகுதி எழுதிய ஆசிரியர்", "ஆசிரியர் என்ன", "ஆசிரியர் எவர்",
    "அதிகம் இயற்றியவர்", "அதிகமாக இயற்றியவர்", "அதிகம் எழுதியவர்", "அதிகமாக எழுதியவர்", "அதிகம் படைத்தவர்", "அதிகமாக படைத்தவர்",
    "அதிக படைப்புகள் உள்ளவர்", "அதிக கட்டுரை எழுதியவர்", "குறித்து கட்டுரை எழுதிய ஆசிரியர்", "குறித்து கட்டுரை எழுதியவர் யார்",
    "குறித்து கட்டுரை எழுதியவர்", "குறித்து எழுதிய ஆசிரியர்", "குறித்து எழுதியவர் யார்", "குறித்து எழுதியவர்",
    "பற்றி கட்டுரை எழுதிய ஆசிரியர்", "பற்றி கட்டுரை எழுதியவர் யார்", "பற்றி கட்டுரை எழுதியவர்", "பற்றி எழுதிய ஆசிரியர்",
    "பற்றி எழுதியவர் யார்", "பற்றி எழுதியவர்", "பற்றிய கட்டுரை எழுதியவர்", "பற்றிய கட்டுரை எழுதிய ஆசிரியர்", "கட்டுரை எழுதிய ஆசிரியர்",
    "கட்டுரை எழுதியவர் யார்", "கட்டுரை எழுதியவர்", "பற்றிய படைப்புகள்", "பற்றிய கட்டுரைகள்", "தொடர்பான படைப்புகள்", "தொடர்பான கட்டுரைகள்",
    "பற்றி படைப்புகள்", "who wrote", "who is the author", "author of", "written by", "who composed", "composer of", "who penned",
    "penned by", "who created", "creator of", "who authored", "name of the author", "name of the writer", "who is the writer", "writer of",
)
AUTHOR_ACTION = (
    "என்ன எழுதினார்", "என்னென்ன எழுதினார்", "எழுதியது என்ன", "எழுதியவை என்ன", "எழுதியவை யாவை", "எழுதிய தலைப்பு", "எழுதிய தலைப்புகள்",
    "எழுதிய கட்டுரைகள்", "எழுதிய கட்டுரை", "எழுதிய கதைகள்", "எழுதிய கதை", "எழுதிய கவிதைகள்", "எழுதிய கவிதை", "எழுதிய நாவல்",
    "எழுதிய நாவல்கள்", "எழுதிய படைப்புகள்", "எழுதிய படைப்பு", "எழுதிய தொடர்", "எழுதிய தொடர்கள்", "எழுதிய தொடரின்", "எழுதிய பகுதி",
    "எழுதிய பாடல்", "எழுதிய பாடல்கள்", "இயற்றிய படைப்புகள்", "இயற்றிய கவிதை", "இயற்றிய கவிதைகள்", "இயற்றிய பாடல்", "படைத்த படைப்புகள்",
    "படைத்தவை என்ன", "பங்களிப்புகள்", "பங்களிப்பு என்ன", "பங்கு என்ன", "பங்களிப்பு யாவை", "பற்றி எழுதினார்", "எந்த தலைப்புகள்",
    "எந்தெந்த தலைப்புகள்", "என்னென்ன தலைப்புகள்", "என்னென்ன கதைகள்", "எந்தெந்த கதைகள்", "என்னென்ன கட்டுரைகள்", "அவர் எழுதிய",
    "அவரது படைப்புகள்", "அவரின் படைப்புகள்", "அவர்கள் எழுதிய", "படைப்புகள்", "படைப்புகளை", "படைப்பு என்ன", "படைப்புகளைப் பட்டியலிடுக",
    "பட்டியலிடுக", "தொடரின் பெயர்", "தொடர் பெயர்", "அவர் எழுதிய தொடர்", "எழுதிய தொடரின் பெயர்", "list of writings", "articles by",
    "works of", "works by", "what did write", "list works", "writings by", "contributions by", "what has written", "what wrote",
    "poems by", "stories by", "articles written by", "written works", "literary works", "what authored", "படைப்புகள் யாவை",
)
TITLE_SUFFIXES = (
    "தொடரின்", "தொடர்", "கதையின்", "கதை", "நாவலின்", "கட்டுரையின்", "கவிதையின்", "பாடலின்", "பகுதியின்", "நூலின்", "series", "story",
    "novel", "article", "poem", "part",
)
TOPIC_CONTENT = (
    "பற்றிய படைப்புகள்", "பற்றிய கட்டுரைகள்", "பற்றிய கவிதைகள்", "பற்றிய கதைகள்", "பற்றி படைப்புகள்", "பற்றி கட்டுரைகள்", "தொடர்பான படைப்புகள்",
    "தொடர்பான கட்டுரைகள்", "குறித்த படைப்புகள்", "குறித்த கட்டுரைகள்", "சார்ந்த படைப்புகள்", "சார்ந்த கட்டுரைகள்",
)
ISSUE_OF = ("எந்த மலர்", "எந்த இதழ்", "இதழில் இடம்பெற்றுள்ளது", "எந்த மலர் மற்றும் இதழில்")
START_YEAR = ("எந்த ஆண்டு தொடங்கியது", "முதல் ஆண்டு", "தொடங்கிய ஆண்டு", "எப்போது தொடங்கியது", "start year")
ISSUE_COUNT = ("இதழ் எண்ணிக்கை", "எத்தனை இதழ்", "இதழ்கள் எத்தனை", "மொத்த இதழ்", "இதழ் count", "issue count", "how many issues", "number of issues", "total issues", "இதழ் பட்டியல்", "இதழ்களின் பட்டியல்")
ORDINALS = ("முதல்", "இரண்டாவது", "மூன்றாவது", "நான்காவது", "ஐந்தாவது", "ஆறாவது", "ஏழாவது", "எட்டாவது", "ஒன்பதாவது", "பத்தாவது", "பதினொன்றாவது", "பன்னிரண்டாவது", "பதிமூன்றாவது", "பதினான்காவது", "பதினைந்தாவது", "பதினாறாவது", "பதினேழாவது", "பதினெட்டாவது", "பத்தொன்பதாவது", "இருபதாவது")
CARDINALS = ("ஒன்று", "இரண்டு", "மூன்று", "நான்கு", "ஐந்து", "ஆறு", "ஏழு", "எட்டு", "ஒன்பது", "பத்து", "பதினொன்று", "பன்னிரண்டு", "பதிமூன்று", "பதினான்கு", "பதினைந்து", "பதினாறு", "பதினேழு", "பதினெட்டு", "பத்தொன்பது", "இருபது")

FILE_NAMES = (
    r"(?i)VOL\s*[-_]?\s*(\d+)\s*[-_]\s*(\d+)\s*[-_]\s*(\d{4})",
    r"(?i)VOL\s*[-_]?\s*(\d+)\s*[-_]\s*([A-Za-z]+)\s*[-_]\s*(\d{4})",
    r"(?i)vol[-_\s]*(\d+)[-_\s]*(?:issue)?[-_\s]*(\d+)[-_\s]*(\d{4})?",
    r"(\d+)\s*[-_]\s*(\d+)\s*[-_]\s*(\d{4})",
)

# --- Rules. ---

INITIALS = r"[\x{0B80}-\x{0BFF}]{1,3}\.\s*[\x{0B80}-\x{0BFF}]{2,}"
WHO = "யார்"


@dataclass(frozen=True)
class Bank:
    """The caller's names."""

    known_authors: tuple[str, ...] = ()
    canonical: tuple[tuple[str, str], ...] = ()


def has_any(q: Column, words: tuple[str, ...]) -> Column:
    """Literal parts, as one regular expression."""
    if not words:
        return F.lit(False)
    return q.rlike("|".join(r"\Q" + w + r"\E" for w in words))


def query_type(question: Column, bank: Bank = Bank()) -> Column:
    """list_all_authors, topic_author, author_topics or none, in this order of tests (O-191).

    A phrase that starts with 'who' counts only where that is a word of its own.
    """
    q = F.trim(F.lower(question))
    starts_who = tuple(p for p in TOPIC_AUTHOR if p.startswith(WHO))
    rest = tuple(p for p in TOPIC_AUTHOR if WHO not in p)
    inner = tuple(p for p in TOPIC_AUTHOR if WHO in p and not p.startswith(WHO))
    topic = has_any(q, rest + inner) | q.rlike("(^| )(" + "|".join(r"\Q" + p + r"\E" for p in starts_who) + ")")
    author = (has_any(q, bank.known_authors) | q.rlike(INITIALS)) & has_any(q, AUTHOR_ACTION)
    return (
        F.when(has_any(q, YEAR_WORDS) | has_any(q, CONTENT_WORDS), "none")
        .when(has_any(q, LIST_AUTHORS), "list_all_authors")
        .when(topic, "topic_author")
        .when(author, "author_topics")
        .when(has_any(q, TOPIC_CONTENT) | has_any(q, ISSUE_OF), "topic_author")
        .otherwise("none")
    )


def route(question: Column, bank: Bank = Bank()) -> Column:
    """The handler: start_year, issue_count, contents, a query type, or vector_search (O-195)."""
    q = F.lower(question)
    numbers = issue_numbers(question)
    kind = query_type(question, bank)
    return (
        F.when(has_any(q, START_YEAR), "start_year")
        .when(has_any(q, ISSUE_COUNT), "issue_count")
        .when(numbers["volume"].isNotNull() & numbers["issue"].isNotNull(), "contents")
        .when(kind != "none", kind)
        .otherwise("vector_search")
    )


def issue_numbers(question: Column) -> Column:
    """struct<volume, issue> of a question about an issue's contents, in digits or Tamil words (O-194)."""
    words = [(w, i) for names in (ORDINALS, CARDINALS) for i, w in enumerate(names, 1)]
    table = F.create_map(*(F.lit(x) for pair in words for x in pair))
    any_number = r"(\d+|" + "|".join(sorted((w for w, _ in words), key=len, reverse=True)) + ")"

    ordinal = "(" + "|".join(ORDINALS) + ")"

    def number(noun: str) -> Column:
        """An ordinal stands before its noun; other numbers follow it or, last, precede it."""
        forms = (ordinal + r"\s*" + noun, noun + r"\s*[-:]?\s*" + any_number, any_number + r"\s*" + noun)
        found = F.coalesce(*(F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in forms))
        return F.coalesce(F.try_element_at(table, found), found.try_cast("int"))

    return F.struct(number("மலர்").alias("volume"), number("இதழ்").alias("issue"))


def entity(question: Column, bank: Bank = Bank(), noise: tuple[str, ...] = ()) -> Column:
    """The name a question asks about: a canonical name, a name with initials, else up to three words left without noise (O-192)."""
    q = T.without_possessive(F.trim(question))
    named = F.lit(None).cast("string")
    for variant, name in reversed(bank.canonical):
        named = F.when(F.contains(F.lower(q), F.lit(variant.lower())), F.lit(name)).otherwise(named)
    bare = q
    for phrase in sorted(set(noise) | set(AUTHOR_ACTION) | set(TOPIC_AUTHOR) | set(LIST_AUTHORS), key=lambda p: (-len(p), p)):
        bare = F.replace(bare, F.lit(phrase), F.lit(" "))
    words = F.filter(F.split(F.regexp_replace(bare, r"[?!.,\"']", " "), r"\s+"), lambda w: w != "")
    return F.coalesce(named, F.nullif(F.regexp_extract(q, "(" + INITIALS + ")", 1), F.lit("")), F.array_join(F.slice(words, 1, 3), " "))


def file_numbers(name: Column) -> Column:
    """struct<volume, issue, year> of a file name, by four patterns in order (O-172)."""

    def part(group: int) -> Column:
        out = F.lit(None).cast("string")
        for p in reversed(FILE_NAMES):
            out = F.when(name.rlike(p), F.nullif(F.regexp_extract(name, p, group), F.lit(""))).otherwise(out)
        return out

    number = lambda c: F.coalesce(F.regexp_replace(F.when(c.rlike(r"^\d+$"), c), r"^0+(?=\d)", ""), F.upper(c))
    issue = number(part(2))
    return F.struct(number(part(1)).alias("volume"), F.when(issue == "PONGAL", "பொங்கல் மலர்").otherwise(issue).alias("issue"), part(3).alias("year"))


def valid_author(c: Column) -> Column:
    """A plausible name (O-066): 2 to 40 characters with Tamil, 3 dots and 2 commas at most, no ellipsis, no Latin word, not a page number."""
    body = T.strip(c)
    count = lambda p: F.length(body) - F.length(F.replace(body, F.lit(p), F.lit("")))
    return F.coalesce(F.length(body).between(2, 40) & body.rlike(r"[\x{0B80}-\x{0BFF}]") & (count(".") <= 3) & (count(",") <= 2) & ~F.contains(body, F.lit("…")) & ~body.rlike("[A-Za-z]{3}") & ~body.rlike(r"^[-–—\s]*\d+[-–—\s]*$"), F.lit(False))


def contents_line(line: Column, section_types: tuple[str, ...] = ()) -> Column:
    """struct<title, author, page> of a contents line that ends in a page number; null otherwise (O-176).

    Wide gaps part the columns, the widest kind that does; in a line without any, a
    valid last word may be the author.
    """
    page = F.regexp_extract(line, r"(\d{1,3})\s*$", 1)
    body = F.regexp_replace(F.regexp_replace(line, r"\d{1,3}\s*$", ""), r"(?U)[.\s…]+$", "")
    cleaned = lambda parts: F.filter(F.transform(parts, lambda p: T.strip(F.regexp_replace(p, r"(?U)^[.\s…]+|[.\s…]+$", ""))), lambda p: ~p.rlike(r"(?U)^[.,…\s]*$"))
    split = lambda n: F.split(body, r"(?U)\s{" + str(n) + r",}|\t+")
    words = F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")
    initial = F.try_element_at(words, F.lit(-2)).rlike(r"^[\x{0B80}-\x{0BFF}]\.$")
    take = F.when(initial, 2).otherwise(1)
    single = F.when((F.size(words) >= 3) & valid_author(F.try_element_at(words, F.lit(-1))) & ~F.try_element_at(words, F.lit(-1)).isin(*section_types or ("",)), F.array(F.array_join(F.slice(words, F.lit(1), F.size(words) - take), " "), F.array_join(F.slice(words, F.size(words) - take + 1, take), " "))).otherwise(F.array(body))
    parts = single
    for n in (2, 3, 4):
        parts = F.when(F.size(split(n)) >= 2, split(n)).otherwise(parts)
    segments = cleaned(parts)
    tail = F.try_element_at(segments, F.lit(-1))
    named = (F.size(segments) >= 2) & valid_author(tail) & ~tail.isin(*section_types or ("",))
    title = F.when(named, F.array_join(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), " ")).otherwise(F.array_join(segments, " "))
    return F.when((page != "") & (F.size(segments) > 0), F.struct(title.alias("title"), F.when(named, tail).alias("author"), page.alias("page")))


def to_sentence_end(answer: Column, least: float = 0.3) -> Column:
    """Cut after the last closing mark, if that leaves enough (O-167)."""
    head = F.regexp_extract(answer, r"(?s)^(.*[.?!।])", 1)
    return F.when(F.length(head) > F.length(answer) * least, head).otherwise(answer)


def content_type_flags(question: Column, wh: tuple[str, ...], yes_no: tuple[str, ...], display: tuple[str, ...]) -> Column:
    """struct of three flags by word lists (O-182)."""
    q = F.lower(question)
    return F.struct(has_any(q, wh).alias("wh"), has_any(q, yes_no).alias("yes_no"), has_any(q, display).alias("display"))


def routed(questions: DataFrame, bank: Bank = Bank()) -> DataFrame:
    """questions (qid, text) with route and entity."""
    return questions.withColumn("route", route(F.col("text"), bank)).withColumn("entity", entity(F.col("text"), bank))
