"""N-gram Jaccard join by groups of documents with identical prefixes.

The distinct shingles of a text are put in one order for all texts, rare ones
first, and a text's prefix is so long that two texts within the threshold must share a token
of their prefixes.  Texts with the same prefix and the same set size form one group, which
is listed once.  Frequencies for the order come from a sketch of CELLS counters
over all texts; any order gives the same result, so its size is fixed.

Links are found in two rounds.  First each group of a token's list is confirmed against
the list's first group of like size, and each text against the first text of its group; this
is linear, and joins most of what belongs together.  Then only lists that still hold two
components are filtered: pairs of groups pass by set sizes, token positions and bitmaps.
A short list gives all its pairs, whose bitmaps are then compared once a pair; blocks of a
long one meet in tiles with their bitmaps, and a tile emits a spanning forest of what passes.
The groups of a candidate component are expanded to their texts and verified on full sets
in tiles, as in near_dedup.  So no table grows with the square of a list or a group.

The parity bitmap of a set has a bit or two for every shingle: a bit that differs proves a shingle
that only one set holds, so the number of such bits bounds the similarity from above and no link
is lost.  Pairs are compared by them in both rounds before texts are fetched, and in the second one before
components are formed: the more texts there are, the more of them share a token by chance, and without
bitmaps such pairs would chain most of a large corpus into one component, whose tiles are quadratic.

Defined cases: a null text, or one without words, has no shingles and is linked with
nothing; with fewer words than a shingle the whole sequence is one; rows that repeat both id
and text get the same result; a row with a null doc_id is linked with nothing and has a null
component; extra columns are ignored.  Texts, groups and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, slices, written
from .near_dedup import class_of, components, confirmed, local_stars, near_duplicates_sql, normal_words, roots_of, shingle_set, tiles, word_hashes  # noqa: F401

CELLS, SKETCH_PART = 1 << 20, 1 << 16
LIST_BLOCK = 512
SIZES = "doc_id long, class long, n_shingles long, part int, seen binary"
LISTED = "token long, group long, n long, at int"
PREFIXES = "class long, n_shingles long, group long, prefix array<long>, bits binary"


def cells_of(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles % np.uint64(cells)).astype(np.int64)


def sized(documents: DataFrame, width: int, cells: int = CELLS) -> DataFrame:
    """SIZES: a row per document, and per task a row for each part of the sketch with its counts, two bytes a cell (65535 at most)."""

    def counted(batches: Iterable) -> Iterator:
        import pyarrow as pa

        seen = np.zeros(cells, np.int64)
        none = lambda n, t: pa.nulls(n, t)
        for batch in batches:
            for part in slices(batch, 1):
                classes, sets = [], []
                for text in part.column(1).to_pylist():
                    words = normal_words(text)
                    classes.append(class_of(words))
                    sets.append(shingle_set(word_hashes(words), width))
                seen += np.bincount(cells_of(np.concatenate(sets), cells), minlength=cells)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), none(n, pa.int32()), none(n, pa.binary())],
                    ["doc_id", "class", "n_shingles", "part", "seen"],
                )
        counts = np.minimum(seen, 65535).astype("<u2")
        for part, at in enumerate(range(0, cells, SKETCH_PART)):
            held = pa.array([counts[at : at + SKETCH_PART].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(none(1, pa.int64()) for _ in range(3)), pa.array([part], pa.int32()), held], ["doc_id", "class", "n_shingles", "part", "seen"])

    return map_batches(documents.select("doc_id", "text"), counted, SIZES)


def cell_ranks(rows: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Rank of every cell by what it has counted; the sums, 8 bytes a cell, come to the driver."""

    def summed(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for part, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(seen, "<u2").astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["part", "seen"])

    counted = map_batches(rows.filter("part is not null").select("part", "seen").repartition("part"), summed, "part int, seen binary").toArrow()
    ranks, seen = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for part, held in zip(counted.column("part").to_pylist(), counted.column("seen").to_pylist(), strict=True):
        seen[part * SKETCH_PART : (part + 1) * SKETCH_PART] = np.frombuffer(held, "<i8")
    ranks[np.lexsort((np.arange(cells), seen))] = np.arange(cells)
    return ranks.astype(np.int32)


def among(rows: DataFrame, keys: DataFrame, column: str, most_bits: int = 1 << 24) -> DataFrame:
    """Rows whose key may be among the keys, by a broadcast bitmap of hashed keys: 16 bits a key, ``most_bits`` in all.

    The bitmap never rules out a key that is there; with more keys more rows pass to the join that follows.
    It goes through the driver as one Arrow column, which takes a fraction of the memory of rows.
    """
    import pyarrow as pa

    bits = min(most_bits, 1 << max(6, (16 * keys.count()).bit_length()))
    place = lambda: F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(place().alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[words.column("w").to_numpy()] = words.column("b").to_numpy()
    one = pa.table({"_held": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(held))})
    bitmap = rows.sparkSession.createDataFrame(one)
    seen = F.expr("shiftrightunsigned(_held[cast(shiftright(_place, 6) as int)], cast(_place % 64 as int)) & 1L")
    return rows.crossJoin(F.broadcast(bitmap)).withColumn("_place", place()).filter(seen == 1).select(*rows.columns)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a linked set shares one: n less the least intersection, and one."""
    return n + (-percent * n) // 100 + 1


def parity_bits(shingles: np.ndarray) -> bytes:
    """For every place of a bitmap of 64 bits or more, at least one a shingle, whether it has an odd number of them."""
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    held = np.bincount(((shingles >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) of half the size."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def prefixes(documents: DataFrame, width: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """PREFIXES of the documents with words: class, set size, hash of prefix and size, the prefix, rare tokens first, and the parity bitmap."""

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for part in slices(batch, 1):
                classes, sizes, groups, heads, bits, offsets = [], [], [], [], [], [0]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = normal_words(text)
                    if doc_id is None or not words:
                        continue
                    shingles = shingle_set(word_hashes(words), width)
                    head = shingles[np.argsort(ranks[cells_of(shingles, len(ranks))], kind="stable")[: prefix_length(len(shingles), percent)]]
                    classes.append(class_of(words))
                    sizes.append(len(shingles))
                    groups.append(xxhash.xxh3_64_intdigest(head.tobytes(), seed=len(shingles)))
                    heads.append(head)
                    bits.append(parity_bits(shingles))
                    offsets.append(offsets[-1] + len(head))
                tokens = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(groups, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens)), pa.array(bits, pa.binary())],
                    ["class", "n_shingles", "group", "prefix", "bits"],
                )

    return map_batches(documents.select("doc_id", "text"), cut, PREFIXES)


def recurring(batches: Iterable) -> Iterator:
    """LISTED rows sorted by token and group: each group of a token once, without the tokens of one group.  One row is held from batch to batch."""
    import pyarrow as pa

    names = ["token", "group", "n", "at"]
    held, met = None, False  # the last row so far, and whether the one before it has its token
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        token, group = rows[:2]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])
        rows = [c[fresh] for c in rows]
        same = rows[0][1:] == rows[0][:-1]
        before = np.concatenate([[met], same])
        keep = np.flatnonzero(before[:-1] | same)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], names)
        held, met = [c[-1:] for c in rows], bool(before[-1])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)


def lists(cut: DataFrame) -> DataFrame:
    """LISTED: tokens in the prefixes of two groups or more; a group is listed once, whatever its members.  Postings are shuffled once."""
    postings = cut.select(F.posexplode("prefix").alias("at", "token"), "group", F.col("n_shingles").alias("n")).select("token", "group", "n", "at")
    return written(map_batches(postings.repartition("token").sortWithinPartitions("token", "group"), recurring, LISTED))


def size_band(n: Column) -> Column:
    """Sizes within a factor of 0.8 or so."""
    return F.floor(F.log(n.cast("double")) / -F.log(F.lit(0.8)))


def star_pairs(listed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(centre, member) classes of the first round: groups against the first of their list and size band, texts against the first of their group."""
    leaders = members.groupBy("group").agg(F.min("class").alias("leader"))
    firsts = listed.groupBy("token", size_band(F.col("n")).alias("band")).agg(F.min(F.struct("group", "n")).alias("first"), F.max("group").alias("last")).filter("first.group < last")
    pairs = listed.withColumn("band", size_band(F.col("n"))).join(firsts, ["token", "band"]).filter("group <> first.group")
    pairs = pairs.filter(100 * F.least("n", "first.n") >= percent * F.greatest("n", "first.n")).select("group", F.col("first.group").alias("centre")).distinct()
    pairs = pairs.join(leaders, "group").select(F.col("leader").alias("member"), F.col("centre").alias("group")).join(leaders, "group").select(F.col("leader").alias("centre"), "member")
    inside = members.join(leaders, "group").filter("class <> leader").select(F.col("leader").alias("centre"), F.col("class").alias("member"))
    return pairs.unionByName(inside).distinct()


def star_tiles(stars: DataFrame) -> DataFrame:
    """(tile, side, class) of (centre, member): a centre on side 0 with at most LIST_BLOCK or so of its members."""
    stars = checkpoint(stars)
    blocks = stars.groupBy("centre").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks"))
    dealt = checkpoint(stars.join(blocks, "centre").select("member", "centre", F.xxhash64("centre", F.pmod(F.xxhash64("member"), F.col("blocks"))).alias("tile")))
    return dealt.select("tile", F.lit(1).alias("side"), F.col("member").alias("class")).unionByName(dealt.select("tile", F.lit(0).alias("side"), F.col("centre").alias("class")).distinct())


def whole_tiles(batches: Iterable) -> Iterator[list]:
    """Columns, as Arrow arrays, of batches sorted by their first column, dealt anew so that each tile is in one piece."""
    import pyarrow as pa

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        tile = held.column(0).to_numpy()
        ends = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        if len(ends):
            yield held.slice(0, int(ends[-1])).combine_chunks().columns
            held = held.slice(int(ends[-1]))  # the last tile may go on
    if held is not None and held.num_rows:
        yield held.combine_chunks().columns


def tile_ends(tile: np.ndarray) -> np.ndarray:
    """Where each tile of the sorted column begins, and the column's length."""
    return np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])


def maybe_links(bits: list[np.ndarray | None], sizes: np.ndarray, sides: np.ndarray, percent: int, also: Callable | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose bitmaps allow a link; across the sides, if there are two, side 0 first.

    A pair is compared at the size of the smaller bitmap, to which the larger is folded.  No bitmap allows
    every link; ``also`` gives the mask of what else must hold for a row and an array of others.
    """
    unknown = np.array([b is None for b in bits])
    bits = [np.zeros(8, np.uint8) if b is None else b for b in bits]
    lengths = np.array([len(b) for b in bits])
    across = sides.any() and not sides.all()
    label, out = np.arange(len(bits)), []
    held = np.empty(0, np.int64)  # the nodes so far, longest bitmaps first
    rows = np.empty((0, lengths.max()), np.uint8)
    for m in np.unique(lengths)[::-1]:
        while rows.shape[1] > m:
            rows = halved(rows)
        own = np.flatnonzero(lengths == m)
        rows = np.concatenate([rows, np.stack([bits[i] for i in own])])
        first = len(held)
        held = np.concatenate([held, own])
        words = np.ascontiguousarray(rows).view(np.uint64)
        for k in range(max(1, first), len(held)):
            i, others = held[k], held[:k]
            some = 100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])
            if across:
                some &= sides[i] != sides[others]
            if also is not None:
                some &= also(i, others)
            left = np.flatnonzero(some)
            others = others[left]
            differ = np.bitwise_count(words[left] ^ words[k]).sum(axis=1, dtype=np.int64)
            near = others[((100 + percent) * differ <= (100 - percent) * (sizes[i] + sizes[others])) | unknown[i] | unknown[others]]
            for old, at in zip(*np.unique(label[near], return_index=True), strict=True):
                if old != label[i]:
                    label[label == old] = label[i]
                    out.append((i, near[at]) if sides[i] <= sides[near[at]] else (near[at], i))
    return out


def maybe_linked(bits: tuple[list, list], sizes: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """For pairs, row by row, whether their bitmaps allow a link; no bitmap allows every one."""
    length = [np.array([0 if b is None else len(b) for b in side]) for side in bits]
    passes = (length[0] == 0) | (length[1] == 0)
    for x, y in np.unique(np.stack(length, axis=1)[~passes], axis=0).tolist():
        own = np.flatnonzero((length[0] == x) & (length[1] == y))
        a, b = (np.frombuffer(b"".join(side[i] for i in own), np.uint8).reshape(len(own), -1) for side in bits)
        while a.shape[1] > b.shape[1]:
            a = halved(a)
        while b.shape[1] > a.shape[1]:
            b = halved(b)
        differ = np.bitwise_count(np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)).sum(axis=1, dtype=np.int64)
        passes[own] = (100 + percent) * differ <= (100 - percent) * (sizes[0][own] + sizes[1][own])
    return passes


def sifted(rows: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, per tile of (tile, side, class), of the pairs that their bitmaps allow."""

    def sift(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for columns in whole_tiles(batches):
            tile, side, node, n = (c.to_numpy() for c in columns[:4])
            bits, pairs, ends = columns[4], [], tile_ends(tile)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                maps = [np.frombuffer(x, np.uint8) for x in bits.slice(a, b - a).to_pylist()]
                pairs += [(a + i, a + k) for i, k in maybe_links(maps, n[a:b], side[a:b], percent)] if b - a > 1 else []
            both = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[both[:, i]]) for i in (0, 1)], ["a", "b"])

    found = rows.join(maps, "class").select("tile", "side", "class", "n_shingles", "bits")
    return map_batches(found.repartition("tile").sortWithinPartitions("tile"), sift, "a long, b long")


def verified(rows: DataFrame, texts, percent: int, width: int) -> DataFrame:
    """A spanning forest of the links in every tile of (tile, side, class), on full sets."""
    found = rows.join(texts(rows.select("class").distinct()), "class")
    return checkpoint(confirmed(found.repartition("tile").sortWithinPartitions("tile"), percent, width))


#: Rows of a list up to which its passing pairs are compared one by one; a longer one is cut into tiles that hold bitmaps.
SMALL_LIST = 16


def may_pass(rows: tuple[np.ndarray, ...], i, j, percent: int) -> np.ndarray:
    """Whether groups i and j of (size, first common place, lowest and highest component) may be linked and lie in different components.

    What two sets can share after their first common token is bounded by the shorter rest.
    """
    n, at, low, high = rows
    some = np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])
    some &= (100 + percent) * np.minimum(n[i] - at[i], n[j] - at[j]) >= percent * (n[i] + n[j])
    return some & ((low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j]))


def passing_pairs(token: np.ndarray, rows: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """Row pairs of the short lists that pass, at one distance after the other."""
    ends = tile_ends(token)
    until = np.repeat(ends[1:], np.diff(ends))
    found, at = [np.empty((0, 2), np.int64)], np.arange(len(token))
    for step in range(1, SMALL_LIST):
        i = at[at + step < until]
        i = i[may_pass(rows, i, i + step, percent)]
        found.append(np.stack([i, i + step], axis=1))
    return np.concatenate(found)


def group_maps(members: DataFrame, maps: DataFrame) -> DataFrame:
    """(group, size, bits): set size and bitmap of every group; a group of several texts has no bitmap."""
    led = members.groupBy("group").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    return led.join(maps, "class").select("group", F.col("n_shingles").alias("size"), F.when(F.col("class") == F.col("last"), F.col("bits")).alias("bits"))


def paired(lists: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of groups of the short lists (token, group, n, at, low, high) that pass the filters and whose bitmaps allow a link."""

    def passing(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for columns in whole_tiles(batches):
            token, group, n, at, low, high = (c.to_numpy() for c in columns)
            both = np.sort(group[passing_pairs(token, (n, at.astype(np.int64), low, high), percent)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in (0, 1)], ["a", "b"])

    def allowed(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, size_a, size_b = (c.to_numpy() for c in batch.columns[:4])
            some = maybe_linked((batch.column(4).to_pylist(), batch.column(5).to_pylist()), (size_a, size_b), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], ["a", "b"])

    rows = lists.select("token", "group", "n", "at", "low", "high").repartition("token").sortWithinPartitions("token")
    pairs = map_batches(rows, passing, "a long, b long").distinct()
    side = lambda x: maps.select(F.col("group").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b"), allowed, "a long, b long")


def tiled_pairs(lists: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, per tile of the long lists (token, size, group, n, at, low, high), of the pairs that pass the filters and whose bitmaps allow a link."""
    j, block = F.col("j"), F.col("block")
    placed = lists.withColumn("blocks", F.ceil(F.col("size") / LIST_BLOCK)).drop("size").withColumn("block", F.pmod(F.xxhash64("group"), F.col("blocks")))
    placed = placed.join(maps.drop("size"), "group").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("token", F.least(j, block), F.greatest(j, block)).alias("tile")
    tiled = placed.select(tile, F.when(j > block, 0).when(j < block, 1).otherwise(0).alias("side"), "group", "n", "at", "low", "high", "bits")

    def filtered(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for columns in whole_tiles(batches):
            tile, side, group, n, at, low, high = (c.to_numpy() for c in columns[:7])
            bits, pairs, ends, at = columns[7], [], tile_ends(tile), at.astype(np.int64)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if b - a > 1 and low[a:b].min() < high[a:b].max():
                    rows = n[a:b], at[a:b], low[a:b], high[a:b]
                    own = [None if x is None else np.frombuffer(x, np.uint8) for x in bits.slice(a, b - a).to_pylist()]
                    pairs += [(a + i, a + k) for i, k in maybe_links(own, n[a:b], side[a:b], percent, lambda i, k, rows=rows: may_pass(rows, i, k, percent))]
            both = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(group[both[:, i]]) for i in (0, 1)], ["a", "b"])

    return map_batches(tiled.repartition("tile").sortWithinPartitions("tile"), filtered, "a long, b long")


def candidates(listed: DataFrame, labelled: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of groups that share a token and pass the filters and bitmaps, so many that all such pairs are connected; lists of one component are left out."""
    rows = checkpoint(listed.join(labelled, "group"))
    mixed_lists = rows.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("size")).filter("least < most")
    mixed = written(rows.join(mixed_lists.select("token", "size"), "token"))
    long = F.col("size") > SMALL_LIST
    return paired(mixed.filter(~long), maps, percent).unionByName(tiled_pairs(mixed.filter(long), maps, percent))


def join_documents(documents: DataFrame, width: int = 5, percent: int = 80, cells: int = CELLS) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by 100 * |intersection| >= percent * |union| of their shingle sets."""
    if percent < 80:
        raise ValueError("size classes of the tiles are made for similarities of 0.8 or more")
    rows = written(sized(documents, width, cells))
    signed = rows.filter("part is null").drop("part", "seen")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = checkpoint(usable.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles")))
    cut = written(prefixes(documents, width, percent, cell_ranks(rows, cells)))
    members = checkpoint(cut.select("group", "class").distinct())
    listed = lists(cut)

    def texts(wanted: DataFrame) -> DataFrame:
        chosen = written(classes.join(wanted, "class").select(F.col("first_id").alias("doc_id"), "class"))
        return among(documents.select("doc_id", "text"), chosen, "doc_id").join(chosen, "doc_id").select("class", "text")

    maps = checkpoint(cut.select("class", "n_shingles", "bits").dropDuplicates(["class"]))
    stars = sifted(star_tiles(star_pairs(listed, members, percent)), maps, percent).select(F.col("a").alias("centre"), F.col("b").alias("member"))
    links = verified(star_tiles(stars), texts, percent, width)
    roots = components(links)
    labelled = members.join(roots, members["class"] == roots["node"], "left").groupBy("group").agg(F.min(F.coalesce("root", "class")).alias("low"), F.max(F.coalesce("root", "class")).alias("high"))
    labelled = checkpoint(labelled)
    edges = candidates(listed, labelled, checkpoint(group_maps(members, maps)), percent)
    clusters = components(edges)
    open_groups = labelled.filter("low < high").select("group")
    named = clusters.select(F.col("node").alias("group"), "root").unionByName(open_groups.select("group", F.col("group").alias("root"))).groupBy("group").agg(F.min("root").alias("root"))
    expanded = named.join(members, "group").groupBy("class").agg(F.min("root").alias("group")).join(classes, "class").select("class", "group", "n_shingles")
    allowed = components(sifted(tiles(checkpoint(expanded)), maps, percent))
    near = allowed.join(classes, allowed["node"] == classes["class"]).select("class", F.col("root").alias("group"), "n_shingles")
    where = written(tiles(checkpoint(near)))
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(where, texts, percent, width))
    rooted = components(joined)
    lowest = classes.join(rooted, classes["class"] == rooted["node"]).groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(lowest, "root").select(F.col("node").alias("class"), "component_id")
    per_class = checkpoint(classes.join(found, "class", "left").select("class", F.coalesce("component_id", "first_id").alias("component_id")))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = signed.join(per_class, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join_documents_sql(width: int = 5, percent: int = 80) -> str:
    """DuckDB SQL for ``join_documents``: all pairs that share a shingle."""
    return f"select doc_id, n_shingles, component_id from ({near_duplicates_sql(width, percent)})"
