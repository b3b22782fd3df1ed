import random

import numpy as np

from lakeleaf.llm import near_dedup as nd


def brute(rows, width, percent):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {}
    for d, text in rows:
        words = nd.normal_words(text)
        n = min(width, len(words))
        sets[d] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def copies(seed, groups=12, most=30):
    """Groups of texts with more and less edited copies."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 20, 60, 150]))]
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                words = words[rng.randrange(4) :]
            rows.append((len(rows) * 3 + 1, ("  " if g % 2 else " ").join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    rng.shuffle(rows)
    return rows


def check(spark, rows, width=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in nd.near_duplicates(df, width, percent).collect()}
    want = brute(rows, width, percent)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())


def test_equals_all_pairs(spark):
    check(spark, copies(1))


def test_large_groups_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE_ROWS", 4)
    check(spark, copies(2, groups=6, most=60))
    monkeypatch.setattr(nd, "TILE_SHINGLES", 300)
    check(spark, copies(3, groups=5, most=40))


def test_five_words_at_eighty_percent(spark):
    check(spark, copies(4), 5, 80)


def test_odd_rows(spark, odd, none):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(odd, 3, 85).collect()}
    assert (1, 10, 1, True) in rows and (2, 10, 1, False) in rows
    assert {(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 0, None, True)} <= rows
    assert (7, 1, 7, True) in rows and (9, 1, 9, True) in rows
    assert nd.near_duplicates(odd, 3, 85).count() == odd.count() and nd.near_duplicates(none).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    m = nd.permutations()
    x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
    agree = lambda f: np.mean(f(m[:, None] * x, axis=1) == f(m[:, None] * y, axis=1))
    assert abs((agree(np.min) + agree(np.max)) / 2 - 0.6) < 0.1


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 1), (20, 21)] + [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 7, 8, 9)) and got[5] == got[4] == 4 and got[21] == 20 and all(got[i] == 100 for i in range(100, 160))


def test_components_take_few_jobs_and_lots_of_few_edges_give_the_same(spark):
    rng = np.random.default_rng(8)
    near = [(int(x) * 100 + int(a), int(x) * 100 + int(b)) for x, a, b in rng.integers(0, 100, (4000, 3))]
    parent = {n: n for e in near for n in e}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    want = {n: top(n) for e in near for n in e if e[0] != e[1]}
    df = spark.createDataFrame(near, "a long, b long").repartition(4).localCheckpoint()
    spark.sparkContext.setJobGroup("few", "components")
    try:
        got = {r["node"]: r["root"] for r in nd.components(df).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == want
    assert jobs <= 30, jobs
    assert {r["node"]: r["root"] for r in nd.components(df, 7).collect()} == want
