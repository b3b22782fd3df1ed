"""SimHash fingerprints of whole documents, on built-in functions only.

The hash of every term votes on 128 signed bits with the term's weight; the
sign of each sum is a bit of the fingerprint.  A term is a lower-cased word and
weighs an eighth of min(length, 8) squared, rounded up, each time it occurs: long
words are rare.

Words are exploded and summed per text in one hash aggregate, whose partial
step meets all words of a text in one task; what is shuffled is a row of sums
per text.  Two counters of 32 bits share a long.  A word of n letters takes n + 1
bytes or more and weighs at most 8/9 of that, so the weights of the longest
string that Spark holds (2**31 bytes) sum to less than 2**31: one rule of weights
fits the counters, and a signed sum, at every length.

Search within a Hamming radius uses permuted block tables: the fingerprint is
cut into radius + 1 blocks, each table leads with one of them, and fingerprints
within the radius must agree on the leading block of at least one table.

Defined cases: null and empty texts have the fingerprint of no votes (zeros);
equal texts have equal fingerprints; the order of ``with_next`` puts null ids
last and breaks ties of ids by a hash of the text, then the text.  Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, written

BITS = 128
LANES = 32
LONG_WORD = 8
#: Cuts per level of two levels of ranges, so RANGES ** 2 buckets at most and 8 * RANGES ** 2 bytes of cuts; parts of a hot id.
RANGES, PARTS = 256, 256
ROWS_A_BUCKET = 1000


def fingerprints(texts: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """keys, carried and ``mark`` (struct<hi, lo>) of every row of (keys, carried, body); keys are unique, carried are longs."""
    words = F.regexp_extract_all(F.lower("body"), F.lit(WORD), 0)
    terms = texts.select(*keys, *carried, F.explode_outer(words).alias("term"))
    letters = F.least(F.coalesce(F.length("term"), F.lit(0)), F.lit(LONG_WORD)).cast("long")
    weight = F.shiftright(letters * letters + 7, 3)
    hashed = terms.select(*keys, *carried, F.xxhash64("term").alias("h0"), F.xxhash64("term", F.lit(1)).alias("h1"), weight.alias("w"))
    # SQL text rather than Column calls: hundreds of small expressions are slow to build one by one.
    lane = lambda half, i: F.expr(f"sum((shiftrightunsigned(h{half}, {i}) & {0x0000000100000001}L) * w) as s{half}_{i}")
    sums = hashed.groupBy(*keys).agg(*(F.expr(f"max({c}) as {c}") for c in carried), F.expr("sum(w) as whole"), *(lane(h, i) for h in (0, 1) for i in range(LANES)))

    def signs(half: int) -> str:
        """Bit 32 * group + lane is counted in lane ``lane``, group ``group``."""
        ones = [(i, f"(s{half}_{i} & {0xFFFFFFFF}L)") for i in range(LANES)] + [(LANES + i, f"shiftrightunsigned(s{half}_{i}, {LANES})") for i in range(LANES)]
        return " | ".join(f"if({count} * 2 > whole, shiftleft(1L, {bit}), 0L)" for bit, count in ones)

    return sums.select(*keys, *carried, F.expr(f"named_struct('hi', {signs(0)}, 'lo', {signs(1)})").alias("mark"))


def as_hex(mark: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(mark[half])), 16, "0") for half in ("hi", "lo")))


def distance(a: Column, b: Column) -> Column:
    """Number of bits that differ."""
    return F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def id_range(lows: list[int]) -> Column:
    """Number of the range of an id: the index of the last start that is not above it; -1 for a null id."""
    starts = f"array({', '.join(f'cast({x} as bigint)' for x in lows)})" if lows else "cast(array() as array<bigint>)"
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.expr(f"size(filter({starts}, a -> a <= doc_id)) - 1"))


def id_cuts(ids: DataFrame) -> tuple[list[int], DataFrame]:
    """(starts of ranges of about equally many ids, (range_no, starts, hot)): a range's starts of buckets, and its ids that fill buckets alone.

    Both levels are quantiles, so clustered ids make no bucket larger than others.
    There are about a bucket per ROWS_A_BUCKET rows, and RANGES ** 2 at most: what
    comes to the driver is RANGES numbers, and what is broadcast a row of at most
    RANGES numbers for each range.
    """
    known = ids.filter("doc_id is not null")
    buckets = min(RANGES**2, max(1, known.count() // ROWS_A_BUCKET))
    ranges = max(1, min(RANGES, round(buckets**0.5)))
    inner = max(1, -(-buckets // ranges))
    points = lambda k: f"percentile_approx(doc_id, array({', '.join(str(i / k) for i in range(1, k + 1))}), 10000)"
    low, cuts = known.agg(F.min("doc_id"), F.expr(points(ranges))).first()
    lows = sorted({low, *cuts[:-1]}) if cuts else []
    per_range = known.withColumn("range_no", id_range(lows)).groupBy("range_no").agg(F.min("doc_id").alias("low"), F.expr(points(inner)).alias("cuts"))
    hot = F.expr("array_distinct(filter(cuts, x -> size(filter(cuts, y -> y = x)) > 1))")
    starts = F.array_sort(F.array_distinct(F.concat(F.array("low"), F.slice("cuts", 1, max(1, inner - 1)) if inner > 1 else F.array("low"), hot)))
    return lows, checkpoint(per_range.select("range_no", starts.alias("starts"), hot.alias("hot")))


def with_next(documents: DataFrame) -> DataFrame:
    """rid, doc_id, text, next_text: the next document by descending id; after the last comes the first.  rid numbers the rows.

    Rows are dealt into buckets (range_no, part_no, sub_no) that follow the order
    of ids.  An id that fills buckets alone, and null, are dealt on by the hash of
    the text, which orders equal ids.  Texts are shuffled once, by bucket; the
    first text of each bucket is also sent to the bucket before it, whose last
    document it follows.  Those few are found by (id, hash) in a written table of
    known size, which Spark broadcasts below its threshold and else joins by sort
    and merge.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    lows, cuts = id_cuts(documents.select("doc_id"))

    def placed(df: DataFrame) -> DataFrame:
        """Adds the bucket.  Larger ranges and parts come first; the smallest id of a bucket, if hot, has the odd part after it."""
        df = df.withColumn("range_no", id_range(lows)).join(F.broadcast(cuts), "range_no", "left")
        own = F.coalesce(F.array_contains("hot", F.col("doc_id")), F.lit(False))
        part_no = F.when(F.col("doc_id").isNull(), 0).otherwise(F.expr("2 * size(filter(starts, a -> a <= doc_id))") - own.cast("int"))
        sub_no = F.when(own | F.col("doc_id").isNull(), F.pmod(F.col("h"), F.lit(PARTS)).cast("int")).otherwise(0)
        return df.select(*(c for c in df.columns if c not in ("starts", "hot")), part_no.alias("part_no"), sub_no.alias("sub_no"))

    key = ["range_no", "part_no", "sub_no"]
    buckets = placed(rows.select("doc_id", "h")).groupBy(*key).agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("g"))).alias("top"))
    before = F.lag(F.struct(*key)).over(Window.partitionBy("range_no").orderBy(F.col("part_no").desc(), "sub_no"))
    buckets = checkpoint(buckets.withColumn("before", before))  # a row per bucket
    ends = buckets.groupBy("range_no").agg(F.min(F.struct("part_no", (-F.col("sub_no")).alias("s"))).alias("e"))  # RANGES + 1 rows at most
    ring, everything = Window.orderBy("range_no"), Window.partitionBy()
    last = F.struct("range_no", F.col("e.part_no").alias("part_no"), (-F.col("e.s")).alias("sub_no"))
    ends = ends.select("range_no", F.coalesce(F.lead(last).over(ring), F.min_by(last, "range_no").over(everything)).alias("end"))
    to = F.coalesce("before", "end")
    tops = written(buckets.join(F.broadcast(ends), "range_no").select(F.col("top.doc_id").alias("top"), F.bitwise_not("top.g").alias("top_h"), to.alias("to")))
    first = rows.join(tops, rows["doc_id"].eqNullSafe(tops["top"]) & (rows["h"] == tops["top_h"])).groupBy("to").agg(F.min("text").alias("text"))
    ghosts = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), "to.*", F.lit(True).alias("ghost"))
    real = placed(rows).select("doc_id", "text", "h", *key, F.lit(False).alias("ghost"))
    order = Window.partitionBy(*key).orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
    upper = lambda c, bits: F.shiftleft((F.col(c) + 1).cast("long"), bits)
    rid = upper("range_no", 53).bitwiseOR(upper("part_no", 43)).bitwiseOR(upper("sub_no", 34)).bitwiseOR(F.row_number().over(order).cast("long"))
    following = real.unionByName(ghosts).withColumn("next_text", F.lead("text").over(order)).withColumn("rid", rid)
    return following.filter("not ghost").select("rid", "doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last third of a text replaced by as much of the head of the next."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def block_keys(marks: DataFrame, radius: int) -> DataFrame:
    """Adds (block_no, block): one row per permuted table, keyed by its leading block."""
    n = radius + 1
    text = F.concat(*(F.lpad(F.conv(F.hex(F.col("mark")[h]), 16, 2), 64, "0") for h in ("hi", "lo")))
    bounds = [BITS * i // n for i in range(n + 1)]
    blocks = F.array(*(F.struct(F.lit(i).alias("block_no"), F.conv(F.substring(text, a + 1, b - a), 2, 10).alias("block")) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))))
    return marks.select("*", F.explode(blocks).alias("_b")).select("*", "_b.block_no", "_b.block").drop("_b")


def within_radius(queries: DataFrame, marks: DataFrame, radius: int = 3) -> DataFrame:
    """(query, mark, bits, rows): distinct fingerprints within the radius of each distinct query fingerprint, with their row counts.

    Both sides have a column ``mark``; equal fingerprints are grouped first, so
    a group of exact copies is one row.  The query set is a stated one.
    """
    wanted = block_keys(queries.select("mark").distinct(), radius).select(F.col("mark").alias("query"), "block_no", "block")
    held = block_keys(marks.groupBy("mark").agg(F.count("*").alias("rows")), radius)
    found = wanted.join(held, ["block_no", "block"]).withColumn("bits", distance(F.col("query"), F.col("mark"))).filter(F.col("bits") <= radius)
    return found.select("query", "mark", "bits", "rows").distinct()


def fingerprint_documents(documents: DataFrame, radius: int = 3, query_modulus: int = 100) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    ``n_within`` answers the search for every document whose id is divisible by
    ``query_modulus``: how many documents (itself included) have a fingerprint
    within the radius; null for the others.
    """
    pair = lambda name, c: [F.xxhash64(c).alias(f"{name}_a"), F.xxhash64(c, F.lit(1)).alias(f"{name}_b")]
    changed = edited(F.col("text"), F.col("next_text"))
    digest = F.sha2(changed, 256)
    digests = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha_{i}") for i in range(4)]
    bodies = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), changed.alias("body")))).alias("b")
    texts = with_next(documents).select("rid", "doc_id", F.length("text").cast("long").alias("n_chars"), *pair("own", "text"), *pair("next", "next_text"), *digests, bodies)
    carried = ["doc_id", "n_chars", "own_a", "own_b", "next_a", "next_b", *(f"sha_{i}" for i in range(4))]
    halves = written(fingerprints(texts.select("rid", *carried, "b.which", "b.body"), ["rid", "which"], carried))
    edits = halves.filter("which = 1").select("rid", F.col("mark").alias("edited_mark"))
    plain = halves.filter("which = 0")
    # Equal texts have equal fingerprints, so the largest halves are the fingerprint.  A checkpoint
    # leaves a plain join, whose hot keys (many documents before copies of one text) AQE splits.
    halved = plain.groupBy(F.col("own_a").alias("next_a"), F.col("own_b").alias("next_b")).agg(F.max("mark.hi").alias("hi"), F.max("mark.lo").alias("lo"))
    by_text = checkpoint(halved.select("next_a", "next_b", F.struct("hi", "lo").alias("next_mark")))
    hexed = F.lower(F.concat(*(F.lpad(F.hex(f"sha_{i}"), 16, "0") for i in range(4))))
    marks = written(plain.join(edits, "rid").join(by_text, ["next_a", "next_b"]).select("doc_id", "n_chars", hexed.alias("edited_sha256"), "mark", "edited_mark", "next_mark"))
    asked = marks.filter(F.col("doc_id") % query_modulus == 0)
    near = checkpoint(within_radius(asked, marks, radius).groupBy("query").agg(F.sum("rows").alias("n_within")))
    answered = marks.withColumn("query", F.when(F.col("doc_id") % query_modulus == 0, F.col("mark"))).join(near, "query", "left")
    return answered.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("mark")).alias("fingerprint"),
        as_hex(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
        "n_within",
    )
