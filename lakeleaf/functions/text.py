"""Text columns on built-in functions.  ``W`` spells a word character the same way for Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import udfs as U

W = r"[\p{L}\p{N}_]"
WORDS = r"[\p{L}\p{N}_]+"
TAMIL_OR_WORD = r"[\x{0B80}-\x{0BFF}]+|[\p{L}\p{N}_]+"
SENTENCE = r"[^।.!?]*[।.!?]*"
#: The characters of Unicode's White_Space property.
BLANKS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def word_count(c: Column) -> Column:
    """Tamil runs or word runs; null has none (O-158)."""
    return F.coalesce(F.regexp_count(c, F.lit(TAMIL_OR_WORD)), F.lit(0))


def tokens(c: Column) -> Column:
    return matches(F.lower(c), WORDS)


def strip(c: Column) -> Column:
    """All white space off both ends, not spaces alone."""
    return F.btrim(c, F.lit(BLANKS))


def sentences(c: Column, min_chars: int = 10) -> Column:
    """Sentences with their closing marks, longer than ``min_chars`` (O-159)."""

    def stripped(m: Column) -> Column:
        # A match is a body and its marks, which are at the end.
        body = F.rtrim(m, F.lit("।.!?"))
        return F.concat(strip(body), F.substring(m, F.length(body) + 1, F.length(m)))

    return F.filter(F.transform(matches(c, SENTENCE), stripped), lambda s: F.length(s) > min_chars)


def counted_sentences(c: Column) -> Column:
    """array<struct<t, n>>: sentences with their word counts, as ``chunks`` takes them."""
    return F.transform(sentences(c), lambda s: F.struct(s.alias("t"), word_count(s).alias("n")))


def chunks(column: str, size: int = L.CHUNK_SIZE) -> Column:
    """Greedy fold of the counted sentences in a column into chunks (O-160): target size // 6 words, at most 1.5 times as many.

    An oversized sentence closes what is open and stands alone; what is open is
    closed before it would overflow and once it reaches the target; at the end it
    is kept if it has 10 words.  Only the counts go through Arrow, in one pass; the
    texts are cut by the spans it finds.
    """
    counts = F.transform(column, lambda s: s["n"])
    spans = U.chunk_spans(counts, F.lit(size // 6), F.lit(int(size // 6 * 1.5)))
    return F.transform(spans, lambda x: F.array_join(F.transform(F.slice(column, x["first"] + 1, x["n"]), lambda s: s["t"]), " "))


def chunk_ok(c: Column, tamil: bool = True) -> Column:
    """20 characters, 10 words and, unless told otherwise, 20 Tamil code points (O-068)."""
    body = strip(F.coalesce(c, F.lit("")))
    ok = (F.length(body) >= 20) & (word_count(body) >= 10)
    return ok & (F.size(matches(body, r"[\x{0B80}-\x{0BFF}]")) >= 20) if tamil else ok


def sanitize(c: Column) -> Column:
    """NFC, then controls, quotes, rulers, fences and runs of blanks (O-161)."""
    c = U.nfc(c)
    steps = (
        (r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]", ""),
        (r"[\"']", ""),
        (r"={4,}", "---"),
        (r"`{3,}", "'"),
        (r"\n{3,}", "\n\n"),
        (r" {3,}", " "),
    )
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def truncate(c: Column, most: int = L.MAX_QUERY) -> Column:
    """Sanitised, at most so many characters, cut at the last space if that is past half (O-162)."""
    c = sanitize(c)
    head = F.substring(c, 1, most)
    last = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last > most // 2), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(strip(cut))


def any_of(c: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    return F.coalesce(c.rlike(flags + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def injection_severity(c: Column) -> Column:
    """'high', 'medium' or null (O-163)."""
    return F.when(any_of(c, L.INJECTION_HIGH), F.lit("high")).when(any_of(c, L.INJECTION_MEDIUM), F.lit("medium"))


def leaks(c: Column, patterns: tuple[str, ...] = L.LEAKAGE) -> Column:
    return any_of(c, patterns)


def says_no_data(c: Column) -> Column:
    return any_of(c, L.NO_DATA_TAMIL, "") | any_of(c, L.NO_DATA_ENGLISH)


def normal_line(c: Column) -> Column:
    """Without dots and white space, lower case (O-156)."""
    return F.lower(F.regexp_replace(c, r"(?U)[.\s]", ""))


def without_symbols(c: Column) -> Column:
    """Also loses vowel signs, which are no word characters (O-157)."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", " "))


def canonical(c: Column) -> Column:
    """'1.0' becomes '1' (O-070)."""
    return F.regexp_replace(F.trim(c), r"^(-?\d+)\.0+$", "$1")


def valid_heading(c: Column) -> Column:
    body = strip(c)
    return F.coalesce((body != "") & ~body.rlike(r"^\d+$") & (F.length(body) < 25) & ~body.rlike("^[—–-]"), F.lit(False))


def authors_of(c: Column) -> Column:
    """Author names of a catalogue cell (O-061): sentinels are none, brackets go, commas part."""
    body = F.trim(F.coalesce(c, F.lit("")))
    inner = F.when(body.rlike(r"^\[.*\]$"), F.regexp_replace(body, r"^\[|\]$", "")).otherwise(body)
    names = F.filter(F.transform(F.split(inner, ","), lambda a: F.trim(a)), lambda a: (a != "") & ~F.lower(a).isin("na", "nan", "none"))
    return F.when(body.isin("[]", "", "NA", "nan", "None"), F.expr("cast(array() as array<string>)")).otherwise(names)


def author_display(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("NA"))


def author_key(c: Column) -> Column:
    """Name without honorifics, blanks, dots and long vowels (O-151); the caller gives NFC text."""
    c = F.trim(c)
    for p in L.HONORIFICS:
        c = F.regexp_replace(c, "(?iu)" + p, "")
    c = F.regexp_replace(c, r"[ .]", "")
    for a, b in L.VOWEL_FOLDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.lower(F.trim(F.replace(c, F.lit("ாமூர்த்தி"), F.lit("மூர்த்தி"))))


def without_possessive(c: Column) -> Column:
    """13 suffix rules in order, each before a blank or the end (O-155)."""
    for suffix, by in L.POSSESSIVES:
        c = F.regexp_replace(c, rf"{suffix}(?=\s|$)", by)
    for suffix in L.POSSESSIVES_AFTER_TAMIL:
        c = F.regexp_replace(c, rf"([\x{{0B80}}-\x{{0BFF}}]){suffix}(?=\s|$)", "$1")
    return c


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b), 1) >= 0


def safe_to_correct(a: Column, b: Column) -> Column:
    """Lengths differ by 2 at most and 3 leading characters agree (O-179)."""
    return (F.abs(F.length(a) - F.length(b)) <= 2) & (F.length(a) >= 3) & (F.substring(a, 1, 3) == F.substring(b, 1, 3))


def content_tokens(c: Column) -> Column:
    """Tamil, Latin and digit runs of two characters and more that are no stop words; the caller gives NFC text (O-168)."""
    found = matches(F.lower(c), r"[\x{0B80}-\x{0BFF}a-z0-9]+")
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*L.STOP_WORDS))


def phrases(c: Column, shortest: int = 2, longest: int = 4) -> Column:
    """Contiguous n-grams of the content tokens, longer ones first (O-168)."""
    toks = content_tokens(c)

    def grams(n: int) -> Column:
        starts = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))

    return F.concat(*(grams(n) for n in range(longest, shortest - 1, -1)))


def shares_prefix(a: Column, b: Column) -> Column:
    """Common prefix of max(3, 0.6 of the shorter) characters (O-169)."""
    shorter = F.least(F.length(a), F.length(b))
    n = F.greatest(F.lit(3), F.floor(shorter * 0.6).cast("int"))
    return (shorter >= 3) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def best_excerpt(content: Column, keywords: Column, most: Column | int, low: Column | None = None) -> Column:
    """The window with most keyword occurrences, the earliest among equals; the head where none occurs (O-137).

    ``low`` is the lower-case content; long texts want it as a column of its own, as
    every window is cut from it.
    """
    low, size = F.lower(content) if low is None else low, F.lit(most) if isinstance(most, int) else most.cast("int")
    step = F.greatest(F.lit(100), F.floor(size / 10).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(low) - size), step)
    hits = lambda w: F.aggregate(keywords, F.lit(0), lambda n, k: n + occurrences(w, k))
    windows = F.transform(starts, lambda p: F.substring(low, p + 1, size))
    best = F.array_max(F.transform(windows, lambda w, i: F.struct(hits(w).alias("n"), (-i).alias("i"))))
    chosen = F.when(best["n"] > 0, -best["i"] * step).otherwise(F.lit(0))
    return F.when(F.length(content) <= size, content).otherwise(F.substring(content, chosen + 1, size))


def year_of(key: Column) -> Column:
    found = F.regexp_extract(key, r"((?:19|20)\d{2})", 1)
    return F.when(found == "", F.lit("Unknown")).otherwise(found)


def volume_of(path: Column) -> Column:
    """First path part that starts with vol_, else 'unknown' (O-014)."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda p: F.lower(p).startswith("vol_")), F.lit(0)), F.lit("unknown"))


def normal_key(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(c), r"(?U)\s+", "_"), F.lit("_."), F.lit("."))


def metric_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\x{00A0}\x{200B}-\x{200D}\x{FEFF}]+", " "))


def base64url(c: Column) -> Column:
    """Without padding and without the line breaks that Spark puts after every 76 characters."""
    return F.rtrim(F.translate(F.base64(c), "+/\r\n", "-_"), F.lit("="))


def folded_issue(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.contains("pongal") | low.contains("பொங்கல்"), F.lit("pongal")).otherwise(low)


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
