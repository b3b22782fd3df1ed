"""Periodic run detection: all maximal repetitions of words in a text, by the runs theorem.

The root of every run starts a longest Lyndon word under one of the two orders of the
alphabet, and that word ends before the next suffix that is smaller in this order.
So with the inverse suffix array, next-smaller and next-greater values give 2n
candidates.  Each is stretched to both sides by the longest common extension, the
minimum of the LCP array between two ranks (a sparse table, one level in memory at
a time; the left side on the reversed words), and is a run if it reaches two periods.

Suffix arrays double the compared length and sort only what is still tied.  Many short
texts are one array: the words of each are an alphabet of their own, closed by a
mark that occurs once, so that no repetition crosses texts.  Everything is numpy
over half a megabyte of texts in a task; a longer text is alone.  A text of n words
needs about 4 bytes a word for every doubling up to its longest repeated stretch.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed
text; repeated rows give the same result each; extra columns are ignored; a null
doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_batches, slices

LEAST = 12
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


# --- Suffix arrays ---


def ranked_suffixes(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rank of every suffix, and the ranks by the first 1, 2, 4, ... keys before that.

    A rank is the number of suffixes before the tied ones, so untied suffixes keep theirs.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank, levels, h = np.empty(n, np.int32), [], 1
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = np.bincount(rank, minlength=n)[rank] > 1
        active = np.flatnonzero(tied)
        if not len(active):
            return rank, levels
        levels.append(rank.copy())
        nearest = np.minimum(active + h, n - 1)
        second = np.where(active + h < n, rank[nearest].astype(np.int64) + 1, 0)
        both = rank[active].astype(np.int64) * (n + 1) + second
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        first = np.ones(len(both), bool)
        first[1:] = both[1:] != both[:-1]
        group = rank[active]
        opens = np.ones(len(both), bool)
        opens[1:] = group[1:] != group[:-1]
        at = np.arange(len(both))
        place = at - np.maximum.accumulate(np.where(opens, at, 0))
        rank[active] = group + np.maximum.accumulate(np.where(first, at, 0)) - at + place
        h *= 2


def neighbour_lcp(rank: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of the suffixes of ranks i and i + 1, from the ranks of doubled lengths."""
    n = len(rank)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    lcp = np.zeros(n - 1, np.int32)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return lcp


def extensions(rank: np.ndarray, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common extension of the suffixes at a and b (different ones): a range minimum of the LCP array.

    Levels of the sparse table are made one after the other, and each answers the queries of its width.
    """
    low, high = np.minimum(rank[a], rank[b]).astype(np.int64), np.maximum(rank[a], rank[b]).astype(np.int64)
    width = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of the binary logarithm
    out, row = np.zeros(len(a), np.int64), lcp
    for k in range(int(width.max(initial=-1)) + 1):
        if k:
            row = np.minimum(row[: -(1 << (k - 1))], row[1 << (k - 1) :])
        now = np.flatnonzero(width == k)
        out[now] = np.minimum(row[low[now]], row[high[now] - (1 << k)])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """Position of the next smaller value of each position, the length where there is none.

    A candidate that is not smaller hands on its own candidate: all between is larger.
    """
    n = len(values)
    near = np.arange(1, n + 1)
    held = np.append(values, values.min(initial=0) - 1)
    near = np.append(near, n)
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[held[near[open_]] > held[open_]]
        near[open_] = near[near[open_]]
    return near[:n]


# --- Runs ---


def runs_of(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``least`` keys, by start, then period.

    The last key must occur once and be the smallest of its text.
    """
    none = np.empty(0, np.int64)
    n = len(keys)
    if n < 2:
        return none, none, none
    rank, levels = ranked_suffixes(keys)
    at = np.arange(n)
    found = []
    for values in (rank.astype(np.int64), -rank.astype(np.int64)):
        period = next_smaller(values) - at
        use = at + period < n
        # Two periods need an equal key on one of both sides.
        right = use & (keys == keys[np.minimum(at + period, n - 1)])
        left = use & (at > 0) & (keys[at - 1] == keys[np.minimum(at + period - 1, n - 1)])
        some = np.flatnonzero(right | left)
        found.append((some, period[some]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(start):
        return none, none, none
    ahead = extensions(rank, neighbour_lcp(rank, levels), start, start + period)
    # What cannot reach two periods or the least length with all that lies behind it is left out.
    del levels
    behind = np.zeros(len(start), np.int64)
    back = np.flatnonzero((start > 0) & (start + ahead >= period))
    back = back[keys[start[back] - 1] == keys[start[back] + period[back] - 1]]
    if len(back):
        turned, levels = ranked_suffixes(keys[::-1].copy())
        behind[back] = extensions(turned, neighbour_lcp(turned, levels), n - start[back], n - start[back] - period[back])
    whole = (ahead + behind >= period) & (ahead + behind + period >= least)
    rows = np.unique(np.stack([start - behind, period, period + ahead + behind], axis=1)[whole], axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def keyed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, begins): the words of all texts as numbers, each text an alphabet of its own with a smallest mark behind it."""
    import pyarrow as pa

    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    spread = len(codes.dictionary) + 1
    keys = np.repeat(np.arange(len(texts)), sizes + 1) * spread
    places = np.arange(len(owner)) + owner
    keys[places] += codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return keys, begins


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Mask of the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def find_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and the text without repetitions.

    A run is a stretch with a smallest period, at least twice that and ``least`` words
    long, that no neighbouring word extends.  The collapsed text joins by one
    space the words that no run contains after its first period.
    """

    def found(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1):
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column(1).to_pylist()]
                keys, begins = keyed(words)
                start, length, period = runs_of(keys, least)
                owner = np.searchsorted(begins, start, "right") - 1
                start = start - begins[owner]
                edges = np.searchsorted(owner, np.arange(len(words) + 1))
                collapsed = []
                for i, own in enumerate(words):
                    a, b = edges[i], edges[i + 1]
                    if a < b:
                        stay = kept_words(len(own), start[a:b], length[a:b], period[a:b])
                        own = [own[j] for j in np.flatnonzero(stay)]
                    collapsed.append(b" ".join(own).decode("utf-8", "replace"))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs), pa.array(collapsed, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return map_batches(documents.select("doc_id", "text"), found, RUNS)


# --- The query's texts and digests ---


def with_repeats(documents: DataFrame) -> DataFrame:
    """The documents (doc_id, text), a tenth of them by hash with words from some place on repeated in a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    rows = documents.select("doc_id", "text", h.alias("h"), g.alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform("words", lambda w, i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text."""
    negative = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    best = F.array_max(F.transform("runs", negative))
    line = lambda r: F.concat(*(x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
