"""MinHash near-duplicate detection with min-max signatures.

Each affine permutation of a shingle's 64-bit hash is evaluated once and gives
two signature values, its minimum and its maximum over the set, which halves
the hash evaluations and lowers the estimator's variance.  BANDS bands of ROWS
values make documents candidates; a pair shares no band
with a probability of 9e-6 at a Jaccard similarity of 0.85, and 8e-4 at 0.8.

Texts of equal words are one class.  Classes that share a bucket, directly or
through others, form a candidate group (found by components over one edge per
class and bucket, never by pairs).  Groups are cut into tiles of bounded size;
every pair of classes of a group meets in exactly one tile, which confirms
links on the full shingle sets with one matrix product and emits only a
spanning forest of them, so neither pairs nor links grow with the square of a
group in any table.  Components over the forest give the result.

Classes and shingles are 64-bit hashes: among 3e10 documents a few dozen
classes are expected to collide by chance.

Defined cases: a null text, or one without words, has no shingles and is linked
with nothing; with fewer words than a shingle the whole sequence is one; rows
that repeat both id and text get the same result; a row with a null doc_id is
linked with nothing, has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, checkpoint, map_batches, slices, written

ROWS, BANDS = 7, 30
PERMUTATIONS = ROWS * BANDS // 2
TILE_ROWS, TILE_SHINGLES = 512, 1 << 20
SIGNATURES = "doc_id long, class long, n_shingles long, bands array<long>"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (splitmix64's finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words.  Hashing a word costs no more than looking it up, so nothing is kept."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes.split() splits at exactly the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def class_of(words: list[bytes]) -> int:
    """Signed 64-bit hash of a word sequence."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(b" ".join(words))
    return value - (1 << 64) if value >> 63 else value


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes from word hashes."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, width)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out + hashes[i : n - size + 1 + i])
    return np.unique(out)


def permutations() -> np.ndarray:
    """Odd multipliers; with a mixed argument each is a permutation of 64-bit words."""
    return np.random.default_rng(20_240_229).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(shingles: np.ndarray, multipliers: np.ndarray, step: int = 512) -> np.ndarray:
    """One hash per band of the min-max signature.  The set goes through in slices, so a long text needs little memory."""
    low, high = np.full(len(multipliers), 2**64 - 1, np.uint64), np.zeros(len(multipliers), np.uint64)
    for at in range(0, len(shingles), step):
        values = multipliers[:, None] * shingles[None, at : at + step]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    rows = np.concatenate([low, high]).reshape(ROWS, BANDS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in rows:
        out = mixed(out + r)
    return out


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, class, n_shingles, bands; bands are null for a document without words."""

    def signed(batches: Iterable) -> Iterator:
        import pyarrow as pa

        multipliers = permutations()
        for batch in batches:
            for part in slices(batch, 1):
                classes, counts, bands, offsets = [], [], [], [0]
                for text in part.column(1).to_pylist():
                    words = normal_words(text)
                    shingles = shingle_set(word_hashes(words), width)
                    classes.append(class_of(words))
                    counts.append(len(shingles))
                    if words:
                        bands.append(band_hashes(shingles, multipliers))
                    offsets.append(len(bands) * BANDS)
                values = np.concatenate(bands).view(np.int64) if bands else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(classes, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                    ["doc_id", "class", "n_shingles", "bands"],
                )

    return map_batches(documents.select("doc_id", "text"), signed, SIGNATURES)


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the edges a-b: labels sink along edges and along themselves until they rest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        both = np.minimum(label[x], label[y])
        for side in (x, y):
            np.minimum.at(low, side, both)
            np.minimum.at(low, label[side], both)  # the root hooks on as well, so that trees merge whole
        low = low[low]
        if np.array_equal(low, label):
            return nodes, nodes[label]
        label = low


def local_stars(edges: DataFrame, most_edges: int = 1 << 20) -> DataFrame:
    """(a, b) of the same components, a > b: every node of a task to the smallest that it reaches there, ``most_edges`` or so at a time.

    The last row's larger end goes on into the next lot with its root, so that edges sorted by larger ends
    bring each of those in one piece, as a small star does.
    """

    def contracted(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def stars() -> pa.RecordBatch:
            last = max(held[-1][0][-1], held[-1][1][-1])
            nodes, roots = roots_of(*(np.concatenate(c) for c in zip(*held, strict=True)))
            at = np.searchsorted(nodes, last)
            held[:] = [(nodes[at : at + 1], roots[at : at + 1])]
            below = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(roots[below])], ["a", "b"])

        held: list = []
        fresh = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                fresh += batch.num_rows
            if fresh >= most_edges:
                yield stars()
                fresh = 0
        if fresh:
            yield stars()

    return map_batches(edges.select("a", "b"), contracted, "a long, b long")


def components(edges: DataFrame, most_edges: int = 1 << 20) -> DataFrame:
    """(node, root) of every node of the (a, b) edges, root the component's smallest node.

    The tasks that make the edges contract their own first, and those of larger ends dealt by node once more, so
    that few are left.  Then large stars (the larger neighbours of a node are hooked to its smallest one) alternate
    with such contractions, which hold all edges of a larger end and so are small stars at least.  Grouped minima are
    partial aggregates; the joins back on the node are plain sort-merge joins of two checkpoints, whose hot keys AQE splits.
    A round costs two checkpoints and four shuffles, however few its rows.
    """
    by_larger = lambda e: local_stars(e.repartition("a").sortWithinPartitions("a"), most_edges)
    edges = checkpoint(by_larger(local_stars(edges.filter("a <> b"), most_edges)))
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        below = F.when(F.col("near") < F.col("node"), F.col("near"))
        low = checkpoint(both.groupBy("node").agg(F.min(below).alias("low"), F.max(below).alias("high"), F.max(F.col("near") > F.col("node")).alias("hub")))
        # Done when the edges are stars: every node has one smaller neighbour, or larger ones alone.
        if not low.agg(F.max(F.expr("low < high or low is not null and hub"))).first()[0]:
            return low.select("node", F.coalesce("low", "node").alias("root"))
        large = edges.join(low, edges["b"] == low["node"]).select("a", F.coalesce("low", "b").alias("b"))
        edges = checkpoint(by_larger(large))


def forest(nodes: list[int], sizes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets; with two sides, only links across count.

    Shingles of one set alone cannot be shared and are dropped before the
    intersections of all pairs are taken as a product of 0/1 matrices.
    """
    n = len(nodes)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    rows, cols = owner[use], number[column[use]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common, step = np.zeros((n, n), np.float32), 1024  # whole numbers below 2**24, exact
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(cols, [at, at + step])
        part = np.zeros((n, min(step, int(shared.sum()) - at)), np.float32)
        part[rows[a:b], cols[a:b] - at] = 1
        common += part @ part.T
    across = sides.any() and not sides.all()
    label, out = np.arange(n), []
    for i in range(1, n):
        both = common[i, :i].astype(np.float64)
        linked = 100 * both >= percent * (sizes[i] + sizes[:i] - both)
        if across:
            linked &= sides[i] != sides[:i]
        near = np.flatnonzero(linked)
        for old, at in zip(*np.unique(label[near], return_index=True), strict=True):
            if old != label[i]:
                label[label == old] = label[i]
                out.append((nodes[i], nodes[near[at]]))
    return out


def confirmed(members: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b) links from (tile, side, class, text), one tile at a time.

    A tile in memory is its sets of hashes (8 bytes a shingle, so at most 16 MB by
    TILE_SHINGLES, or two single texts beyond it) and a matrix of 4 bytes a pair.
    """

    def links(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def out() -> pa.RecordBatch:
            nodes = sorted(found)
            sides, sets = np.array([found[n][0] for n in nodes]), [found[n][1] for n in nodes]
            found.clear()
            pairs = forest(nodes, np.array([len(s) for s in sets], np.float64), sets, sides, percent) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        found, tile = {}, None
        for batch in batches:
            for part in slices(batch, 3):
                for t, side, node, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if found and t != tile:
                        yield out()
                    tile, words = t, normal_words(text)
                    if class_of(words) == node:  # another text may repeat the id
                        found[node] = (side, shingle_set(word_hashes(words), width))
        if found:
            yield out()

    return map_batches(members.select("tile", "side", "class", "text"), links, "a long, b long")


def tiles(grouped: DataFrame) -> DataFrame:
    """(class, tile, side) from (class, group, n_shingles).

    A group within TILE_ROWS and TILE_SHINGLES is one tile.  A larger one is cut by size
    class (linked sets differ by one at most) and by hash into blocks of that size; a
    tile is two blocks of the same or adjacent size classes, side telling them apart.
    """
    blocks = lambda: F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int")
    # log of 0.8 rather than of the threshold itself: a margin for the rounding of logarithms.
    sized = grouped.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / -F.log(F.lit(0.8))).cast("int"))
    whole = sized.groupBy("group").agg(blocks().alias("whole"))
    cells = sized.groupBy("group", "band").agg(blocks().alias("cells"))
    counts = cells.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("band", "cells"))).alias("cells"))  # at most some dozens of bands
    placed = sized.join(checkpoint(whole.join(counts, "group")), "group")
    block = F.pmod(F.xxhash64("class"), F.get(F.map_values("cells"), F.array_position(F.map_keys("cells"), F.col("band")).cast("int") - 1))
    placed = placed.withColumn("block", block)
    own, up, down = F.col("cells")[F.col("band")], F.col("cells")[F.col("band") + 1], F.col("cells")[F.col("band") - 1]
    upto = lambda n: F.when(n.isNull(), F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), n - 1))
    same = F.transform(upto(own), lambda j: F.struct(F.xxhash64("group", "band", F.least(j.cast("long"), F.col("block")), F.greatest(j.cast("long"), F.col("block")), F.lit(0)).alias("tile"), F.when(j > F.col("block"), 0).when(j < F.col("block"), 1).otherwise(0).alias("side")))
    higher = F.transform(upto(up), lambda j: F.struct(F.xxhash64("group", "band", F.col("block"), j.cast("long"), F.lit(1)).alias("tile"), F.lit(0).alias("side")))
    lower = F.transform(upto(down), lambda j: F.struct(F.xxhash64(F.col("group"), F.col("band") - 1, j.cast("long"), F.col("block"), F.lit(1)).alias("tile"), F.lit(1).alias("side")))
    one = F.array(F.struct(F.xxhash64("group").alias("tile"), F.lit(0).alias("side")))
    return placed.select("class", F.explode(F.when(F.col("whole") <= 1, one).otherwise(F.concat(same, higher, lower))).alias("t")).select("class", "t.tile", "t.side")


def maybe_in(rows: DataFrame, keys: DataFrame, column: str, most_bits: int = 1 << 24) -> DataFrame:
    """Rows whose key may be among the keys: a bitmap of hashed keys, never false for a key that is there.

    The bitmap has 16 bits a key up to ``most_bits``, which bounds what is broadcast; with
    more keys it only lets more rows through to the join that follows.
    """
    n = keys.count()
    bits = min(most_bits, 1 << max(6, (16 * n).bit_length()))
    place = lambda: F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(place().alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).collect()
    held = [0] * (bits // 64)
    for r in words:
        held[r["w"]] = r["b"]
    bitmap = rows.sparkSession.createDataFrame([(held,)], "_held array<long>")
    seen = F.expr("shiftrightunsigned(_held[cast(shiftright(_place, 6) as int)], cast(_place % 64 as int)) & 1L")
    return rows.crossJoin(F.broadcast(bitmap)).withColumn("_place", place()).filter(seen == 1).select(*rows.columns)


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked when 100 * |intersection| >= percent * |union|; percent is 80 or more.
    """
    if percent < 80:
        raise ValueError("bands and size classes are made for similarities of 0.8 or more")
    signed = written(signatures(documents, width))
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(usable.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles")))
    # One row per class, so that copies are out of the way before bands are exploded; a band's hash tells its number too.
    single = usable.join(classes.select("class", F.col("first_id").alias("doc_id")), ["class", "doc_id"], "left_semi")
    banded = single.select("class", F.explode("bands").alias("value"))
    buckets = banded.groupBy("value").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first < last")
    shared = checkpoint(buckets.select("value", "first"))
    stars = banded.join(shared, "value").filter("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b"))
    groups = components(stars)
    grouped = checkpoint(groups.join(classes, groups["node"] == classes["class"]).select("class", F.col("root").alias("group"), "n_shingles", "first_id"))
    where = written(tiles(grouped.select("class", "group", "n_shingles")))
    chosen = written(grouped.select(F.col("first_id").alias("doc_id"), "class"))
    texts = maybe_in(documents.select("doc_id", "text"), chosen, "doc_id").join(chosen, "doc_id").select("class", "text")
    members = where.join(texts, "class")
    links = confirmed(members.repartition("tile").sortWithinPartitions("tile"), percent, width)
    rooted = components(links)
    lowest = classes.join(rooted, classes["class"] == rooted["node"]).groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(lowest, "root").select(F.col("node").alias("class"), "component_id")
    per_class = checkpoint(classes.join(found, "class", "left").select("class", F.coalesce("component_id", "first_id").alias("component_id")))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = signed.select("doc_id", "class", "n_shingles").join(per_class, "class", "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates_sql(width: int = 3, percent: int = 85) -> str:
    """DuckDB SQL for ``near_duplicates``: all pairs that share a shingle, and components by reachability."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive words as (select doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') as w from documents where doc_id is not null),
parts as (select doc_id, w, unnest(range(1, greatest(2, len(w) - {width - 2}))) as i from words where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i:i + {width - 1}], ' ') as s from parts),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes sx on sx.doc_id = x join sizes sy on sy.doc_id = y where 100 * c >= {percent} * (sx.n + sy.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as a, doc_id as b from words union select r.a, e.y from reach r join both_ways e on e.x = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, m as component_id, d.doc_id = m as kept
from documents d left join sizes using (doc_id) left join (select a, min(b) as m from reach group by a) g on g.a = d.doc_id"""
