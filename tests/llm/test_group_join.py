import random

import numpy as np
import pytest

from lakeleaf.llm import group_join as gj
from lakeleaf.llm import near_dedup as nd

from .test_near_dedup import brute, copies


def check(spark, rows, width=5, percent=80, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in gj.join_documents(df, width, percent, **more).collect()}
    assert got == brute(rows, width, percent)
    return got


def chained(seed, n=60):
    """Texts that share a passage and slide along one long text, so that many pairs lie close to the threshold."""
    rng = random.Random(seed)
    line, shared = [f"c{rng.randrange(10**6)}" for _ in range(400)], [f"s{i}" for i in range(30)]
    rows = []
    for i in range(n):
        at, size = rng.randrange(0, 300), rng.choice([20, 40, 60])
        words = line[at : at + size] if i % 2 else shared + line[at : at + rng.choice([2, 5, 9])]
        rows.append((i * 7, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(1))
def test_equals_all_pairs(spark, seed):
    check(spark, copies(seed + 10))
    check(spark, chained(seed), 3, 85)
    got = check(spark, chained(seed))
    assert len({c for _, c in got.values()}) < len(got)


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(gj, "LIST_BLOCK", 4)
    monkeypatch.setattr(nd, "TILE_ROWS", 4)
    check(spark, copies(21, groups=6, most=50))
    check(spark, chained(22, 90))


def test_any_order_gives_the_same_result(spark):
    check(spark, copies(31) + [(10_000 + d, t) for d, t in chained(32)], cells=1)


def test_odd_rows(spark, odd, none):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in gj.join_documents(odd).collect()}
    assert (1, 8, 1) in rows and (2, 8, 1) in rows and {(3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 0, None)} <= rows
    assert (7, 1, 7) in rows and (9, 1, 9) in rows
    assert gj.join_documents(odd).count() == odd.count() and gj.join_documents(none).count() == 0


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, common = int(rng.integers(1, 60)), int(rng.integers(0, 60))
        universe = rng.permutation(200)
        a = set(universe[:n].tolist())
        b = set(list(a)[: min(n, common)]) | set(universe[n : n + int(rng.integers(0, 8))].tolist())
        if b and 100 * len(a & b) >= 80 * len(a | b):
            heads = [set(sorted(s)[: gj.prefix_length(len(s), 80)]) for s in (a, b)]
            assert heads[0] & heads[1]


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for _ in range(30):
        base = rng.integers(0, 2**63, 300, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[: (size := int(rng.integers(1, 300)))], rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 1)), dtype=np.uint64)])) for _ in range(40)]
        sizes, sides = np.array([len(s) for s in sets]), rng.integers(0, 2, 40)
        maps = [np.frombuffer(gj.parity_bits(s), np.uint8) for s in sets]
        for side in (sides, sides * 0):
            want, got = list(range(40)), list(range(40))
            join = lambda label, a, b: [label[a] if x == label[b] else x for x in label]
            for a, b in gj.maybe_links(maps, sizes, side, 80):
                assert not side.any() or side[a] < side[b]
                got = join(got, a, b)
            for a in range(40):
                for b in range(a):
                    common = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and (not side.any() or side[a] != side[b]):
                        want = join(want, a, b)
                        assert got[a] == got[b]
            assert len(set(got)) > 1


def test_roots_of_edges_and_local_stars_keep_components(spark):
    import numpy as np

    from lakeleaf.llm.near_dedup import components

    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(-50, 700)]
    some = [(int(x) + 1000, int(y) + 1000) for x, y in rng.integers(0, 900, (500, 2))]
    edges = [*chain, *some, (5000, 4000), (5000, 4500), (7, 7)]
    parent = {n: n for e in edges for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    want = {n: top(n) for n in parent}
    nodes, roots = gj.roots_of(*np.array(edges).T)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == want
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for most in (1 << 20, 40):
        assert {r["node"]: r["root"] for r in components(gj.local_stars(df, most)).collect()} == {n: r for n, r in want.items() if n < 1000 or n != r or n in set(want.values()) and list(want.values()).count(n) > 1}
    assert components(gj.local_stars(df.limit(0))).count() == 0


def test_texts_that_share_a_token_by_chance_form_no_candidate_component(spark, monkeypatch):
    """Neighbours share a third of their words, so most pass the filters by sizes and positions, and none is linked."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(40 * 60)]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 60])) for i in range(59)]
    seen = []
    monkeypatch.setattr(gj, "tiles", lambda grouped: seen.append(grouped.count()) or nd.tiles(grouped))
    got = check(spark, rows, cells=1)
    assert len({c for _, c in got.values()}) == len(rows)
    assert seen[0] <= 5


def test_lists_hold_each_group_of_a_recurring_token_once(spark):
    rng = random.Random(7)
    cut = []
    for group in range(40):
        prefix = [*rng.sample(range(60), 5), 1000 + group]
        cut += [(10 * group + k, 30, group, prefix, b"") for k in range(rng.choice([1, 1, 3]))]
    want = {(t, g, 30, at) for _, _, g, prefix, _ in cut for at, t in enumerate(prefix) if len({h for _, _, h, p, _ in cut if t in p}) > 1}
    assert 0 < len(want) < sum(len(prefix) for *_, prefix, _ in cut)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for most in (before, "3", "1"):
            spark.conf.set(key, most)
            got = [tuple(r) for r in gj.lists(spark.createDataFrame(cut, gj.PREFIXES)).select("token", "group", "n", "at").collect()]
            assert len(got) == len(set(got)) and set(got) == want
    finally:
        spark.conf.set(key, before)


def test_pairs_are_compared_by_bitmaps_as_tiles_are():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: (size := int(rng.integers(1, 700)))], rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 1)), dtype=np.uint64)])) for _ in range(60)]
    maps = [None if i % 9 == 0 else gj.parity_bits(s) for i, s in enumerate(sets)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    sizes = np.array([len(s) for s in sets])
    passed = gj.maybe_linked(([maps[i] for i in a], [maps[i] for i in b]), (sizes[a], sizes[b]), 80)
    assert not passed.all()
    for i, k, some in zip(a, b, passed, strict=True):
        common = len(np.intersect1d(sets[i], sets[k]))
        if maps[i] is None or maps[k] is None or 100 * common >= 80 * (sizes[i] + sizes[k] - common):
            assert some
        if i != k and 100 * min(sizes[i], sizes[k]) >= 80 * max(sizes[i], sizes[k]):
            both = [None if maps[x] is None else np.frombuffer(maps[x], np.uint8) for x in (i, k)]
            assert bool(gj.maybe_links(both, sizes[[i, k]], np.zeros(2, int), 80)) == some


def test_sketch_counts_every_shingle(spark):
    rows = [(i, f"a b c d e f {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cells = gj.SKETCH_PART + 10
    ranks = gj.cell_ranks(gj.sized(df, 5, cells), cells)
    counts = np.zeros(cells, int)
    for _, text in rows:
        np.add.at(counts, gj.cells_of(nd.shingle_set(nd.word_hashes(nd.normal_words(text)), 5), cells), 1)
    assert sorted(ranks) == list(range(cells)) and (np.diff(counts[np.argsort(ranks)]) >= 0).all() and counts.max() >= 30
