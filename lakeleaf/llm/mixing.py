"""Mixing sources to target weights by a low-discrepancy schedule.

A source takes its target, rounded to words, in blocks of BLOCK words; the last
block is cut by the word.  Its number of blocks is its share of 2**bits whole points, as
many as hold all blocks.  Slot n of the mix takes the golden-ratio point n * g mod
2**bits, g odd, through the cumulative numbers of blocks to a source: the points
meet every whole number exactly once, so each source gets exactly its blocks,
evenly spread, and points beyond the last source (fewer than half) stay empty.
The slots of a source are ranked, and rank k takes block k of the source's
shuffled stream of words.  A stream is read over again, up to ``repeats``
times, when its target is larger than the source.  This is one rule at every
size; what a document gives does not depend on BLOCK or on the number of slots.

Everything is whole-number arithmetic on built-in functions: reruns agree and
no Python runs on the executors.  Running totals go by (source, hash bucket)
with a second sum over the bucket totals, so a source with a third of all rows
is spread over all tasks.  Slots meet sources, and blocks, by equi-joins on
fine keys.  2**38 slots, or 2.8e14 words, are the most that 64-bit products hold;
a larger mix raises an overflow.

Defined cases: a null text has size 0; a document without words takes part with
nothing taken; a null source is a source of its own, after all others;
repeated rows are documents each; of an empty table nothing is mixed.  Other
columns are ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, word_count

WEIGHTS = (5, 2, 1)
#: Words of a block.
BLOCK = 1024
#: Points are binned by 2**BIN_BITS or more; at most 2**MOST_BINS bins, which is the longest array that a source is exploded from.
BIN_BITS, MOST_BINS = 6, 16
BUCKETS = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """(source, source_no, source_size, weight, target) from (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share the
    total.  No target exceeds ``repeats`` times its source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Numbered within ranges of sources, then by the counts of the ranges before: no task meets all sources.
    first = F.coalesce(F.substring("source", 1, 2), F.lit(""))
    coded = per.select("source", "source_size", F.col("source").isNull().alias("_last"), first.alias("_head"))
    numbered = coded.withColumn("_n", F.row_number().over(Window.partitionBy("_last", "_head").orderBy("source")))
    heads = numbered.groupBy("_last", "_head").agg(F.count("*").alias("_count"))  # a row per first two characters
    before = F.coalesce(F.sum("_count").over(Window.orderBy("_last", "_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = heads.select("_last", "_head", before.alias("_before"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    numbered = numbered.join(starts, ["_last", "_head"]).select("source", "source_size", (F.col("_before") + F.col("_n") - 1).cast("long").alias("source_no"))
    per = checkpoint(numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats))
    level = water_level(per)
    return per.select("source", "source_no", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def water_level(per: DataFrame) -> float:
    """Words per weight of the sources whose target stays under its cap, from (source_size, weight, cap).

    The excess of capped sources is reshared by weight until no other one is
    capped.  Each round is one aggregate; the level only rises.
    """
    total, level = per.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        capped = F.col("cap") / F.col("weight") <= F.lit(level)
        taken, shares = per.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not shares:
            return level
        raised = (total - (taken or 0)) / shares
        if raised <= level:
            return level
        level = raised


def spans(targets: DataFrame) -> DataFrame:
    """Adds quota, the words to take; blocks; lo and hi, the whole points that lead to the source; and bits of the whole mix."""
    quota = F.round("target").cast("long")
    sized = targets.withColumn("quota", quota).withColumn("blocks", F.expr(f"(quota + {BLOCK - 1}) div {BLOCK}"))
    whole, sources = sized.agg(F.sum("blocks"), F.count("*")).first()
    part = F.expr(f"source_no div {max(1, round((sources or 1) ** 0.5))}")  # rows and parts are both few: the root of the sources
    summed = with_running_total(sized.withColumn("_part", part), [], "_part", ["source_no"], F.col("blocks"), "lo")
    bits = max(0, (whole or 0) - 1).bit_length()
    return summed.select("source", "source_no", "source_size", "target", "quota", "blocks", "lo", (F.col("lo") + F.col("blocks")).alias("hi"), F.lit(bits).alias("bits"))


def golden(slot: str, bits: int) -> str:
    """SQL of the point of a slot: slot * g mod 2**bits, in two steps of 16 bits, so that products stay below 2**62."""
    g, mask = int(2**bits * (math.sqrt(5) - 1) / 2) | 1, (1 << bits) - 1
    return f"(((shiftright({slot}, 16) * {g}L & {mask}L) * 65536L) + ({slot} & 65535L) * {g}L) & {mask}L"


def schedule(spanned: DataFrame) -> DataFrame:
    """(slot, source_no, block): slots of a source in order take its blocks in order."""
    spark = spanned.sparkSession
    bits = spanned.agg(F.max("bits")).first()[0] or 0
    width = max(BIN_BITS, bits - MOST_BINS)
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), F.expr(golden("id", bits)).alias("point")).withColumn("bin", F.shiftright("point", width))
    # Every source has a point of its own for each block, so a bin of 2**width points meets that many sources at most.
    cells = spanned.filter("hi > lo").select("source_no", "lo", "hi", F.explode(F.expr(f"sequence(shiftright(lo, {width}), shiftright(hi - 1, {width}))")).alias("bin"))
    hits = points.join(cells, "bin").filter("point >= lo and point < hi").select("slot", "source_no", F.expr(f"slot div {max(1, min(1 << 22, (1 << bits) // BUCKETS))}").alias("part"))
    return with_running_total(hits, ["source_no"], "part", ["slot"], F.lit(1), "block").select("slot", "source_no", "block")


def with_running_total(rows: DataFrame, keys: list[str], part: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before a row within its keys.

    Rows are summed within (keys, part) and the totals of the parts before are
    added; part must follow the order.  A hot key is thus spread over its parts.
    """
    rows = rows.withColumn("_value", value)
    per_part = rows.groupBy(*keys, part).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select(*keys, part, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(base, [*keys, part])
    return summed.withColumn(name, F.col("_base") + F.col("_inside")).drop("_value", "_inside", "_base")


def positions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(row, doc_id, size, source_no, begin): where each document begins in its source's shuffled stream.

    Shuffled by md5 of the id; the first two hex digits are the bucket.
    """
    # The table of targets has a row per source and is joined by its own size; Spark broadcasts it only below its threshold.
    rows = sized.join(targets.select("source", "source_no", "source_size", "target", "quota"), sized["source"].eqNullSafe(targets["source"])).drop("source")
    rows = rows.withColumn("shuffled", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/mix")).cast("binary")))
    rows = rows.withColumn("part", F.substring("shuffled", 1, 2))
    return with_running_total(rows, ["source_no"], "part", ["shuffled", "copy"], F.col("size"), "begin")


def pieces(placed: DataFrame, repeats: int = 3) -> DataFrame:
    """Parts of documents by block: (doc_id, copy, source_no, block, words, cycle), a cycle being one pass over the source; the last block is cut at the quota."""
    cycles = placed.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("cycle")).withColumn("at", F.expr("begin + cycle * source_size"))
    reached = cycles.filter("at < quota").withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota")))
    cut = reached.select("doc_id", "copy", "source_no", "cycle", "at", "end", "size", F.explode(F.expr(f"sequence(at div {BLOCK}, (end - 1) div {BLOCK})")).alias("block"))
    return cut.withColumn("words", F.expr(f"least(end, (block + 1) * {BLOCK}) - greatest(at, block * {BLOCK})"))


def sized_documents(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, copy: equal rows are told apart by number."""
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    again = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    return again.select("doc_id", "source", "size", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: taken are the words that the scheduled blocks take of it."""
    sized = checkpoint(sized_documents(documents))
    spanned = checkpoint(spans(source_targets(sized, weights, repeats)))
    placed = checkpoint(positions(sized, spanned))
    taken = (
        pieces(placed, repeats)
        .join(schedule(spanned), ["source_no", "block"])
        .groupBy("doc_id", "source_no", "size", "copy")
        .agg(F.sum("words").alias("taken"))
    )
    keys = ("doc_id", "source_no", "size", "copy")
    taken = taken.select(*(F.col(c).alias(f"_{c}") for c in keys), "taken")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    words = F.coalesce("taken", F.lit(0)).cast("long")
    return placed.join(taken, same, "left").select("doc_id", "size", "source_size", "target", words.alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """All columns of the documents, each as often as the mix reads it, whole: once per pass that takes at least half of it.

    Whole documents suit what follows a mix; a source thus differs from its taken
    words by about a document.  A document's verdict is joined by its id; rows
    with words that repeat an id (or have none) share the larger of their counts.
    """
    taken = mix(documents, weights, repeats).filter("size > 0").select("doc_id", F.expr("cast(floor(taken / size + 0.5) as int)").alias("_times"))
    times = taken.filter("_times > 0").groupBy("doc_id").agg(F.max("_times").alias("_times"))
    whole = documents.filter(word_count(F.col("text")) > 0).select(F.struct("*").alias("d"))  # a struct keeps its columns' names apart from ours
    joined = whole.join(times, F.col("d.doc_id").eqNullSafe(F.col("doc_id")))
    return joined.select("d", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("d.*")


def mix_sql(weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> str:
    """DuckDB SQL for ``mix``: of every document the words that lie before its source's target, in up to three passes."""
    size = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
    case = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return f"""
with docs as (select doc_id, source, cast({size} as bigint) as size from documents),
sized as (select *, row_number() over (partition by doc_id, source, size order by doc_id) as copy from docs),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
no as (select *, row_number() over (order by source asc nulls last) - 1 as source_no from per),
wt as (select *, case source_no % {len(weights)} {case} end as weight, source_size * {repeats} as cap from no),
lv as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over w, 0) as double) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from wt window w as (order by cap / weight, source_no rows between unbounded preceding and 1 preceding)),
wa as (select *, coalesce(max(case when cap / weight > level then level end) over (), max(cap / weight) over ()) as water from lv),
ta as (select source, source_no, source_size, case when cap / weight <= water then cast(cap as double) else weight * water end as target from wa),
pl as (select sized.*, source_no, source_size, target, coalesce(sum(size) over (partition by source_no order by md5(coalesce(cast(doc_id as varchar), '') || '/mix'), copy rows between unbounded preceding and 1 preceding), 0) as b
  from sized join ta on sized.source is not distinct from ta.source)
select doc_id, size, source_size, target, cast(greatest(0, least(b + size, q) - b) + greatest(0, least(b + source_size + size, q) - b - source_size) + greatest(0, least(b + 2 * source_size + size, q) - b - 2 * source_size) as bigint) as taken
from (select *, cast(round(target) as bigint) as q from pl)"""
