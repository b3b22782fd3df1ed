import pytest

from lakeleaf.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert_same(spark, name, QUERIES[name], ORACLE_SQL[name])


def test_links_between_hosts_equal_sql(spark, tmp_path):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    rows = [
        (1, "http://good.org/fr/1", link("mid.com", "Other.com")),
        (2, "http://mid.com/en/1", link("far.com", "bad.net", "mid.com")),
        (3, "http://far.com/", None),
        (4, "http://bad.net/", link("far.com")),
        (5, "http://example.com/de/9?q#f", ""),
        (6, "http://farm.com/de", "<a href=//bad.net>x</a><a href='/local'>x</a>"),
        (7, None, link("bad.net")),
        (8, "no scheme", link("bad.net")),
        (9, "HTTP://Sub.EXAMPLE.net/en/#x", link("lone.com")),
        (9, "HTTP://Sub.EXAMPLE.net/en/#x", link("lone.com")),
        (None, "http://linker.com", link("bad.net", "evil.net")),
        (10, "http://notexample.net.evil.com/de/", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    from lakeleaf.llm import url_trust

    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["page_id"], r["host"]): r.asDict() for r in url_trust.filter_urls(pages.selectExpr("*", "1 as host", "2 as rule", "3 as trust")).collect()}
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.sql(url_trust.filter_urls_sql())
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert len(want) == len(rows)
    for w in want:
        assert got[w["page_id"], w["host"]] == w
    assert got[6, "farm.com"]["distrust"] > 0 and got[2, "mid.com"]["trust"] > 0
    assert got[8, ""]["verdict"] == "allow" and got[7, ""]["rule"] is None
    assert got[4, "bad.net"]["rule"] == "net/" and got[10, "notexample.net.evil.com"]["rule"] is None
    assert url_trust.filter_urls(pages.limit(0)).count() == 0


def test_trust_reaches_hosts_behind_more_than_ten_links(spark):
    from lakeleaf.llm import url_trust

    seeds = spark.createDataFrame([("trust", "h00", 1_000_000)], "kind string, host string, score long")
    edges = spark.createDataFrame([(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(14)], "src string, dst string, pages long")
    want = {"h00": 150_000}
    for i in range(14):
        want[f"h{i + 1:02}"] = want[f"h{i:02}"] * 85 // 100
    assert {r["host"]: r["score"] for r in url_trust.propagate(seeds, edges).collect()} == want
    assert len(url_trust.propagate(seeds, edges, iterations=3).collect()) == 4


def test_walks_equal_power_iteration_on_a_random_graph(spark):
    """3000 hosts, links to a few hubs and at random, dangling hosts; floating point by matrix against whole numbers."""
    import numpy as np

    from lakeleaf.llm import url_trust

    rng, n = np.random.default_rng(11), 3000
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (9000, 2)) if a != b and a % 7} | {(int(a), int(a) % 20) for a in rng.integers(20, n, 1500) if a % 7}
    pages = {link: int(rng.integers(1, 4)) for link in links}
    seeds = {("trust", int(i)): int(rng.integers(1, 10**6)) for i in rng.choice(n, 40, replace=False)} | {("distrust", int(i)): 10**6 for i in rng.choice(n, 40, replace=False)}
    seed_df = spark.createDataFrame([(k, f"h{i}", s) for (k, i), s in seeds.items()], "kind string, host string, score long")
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", p) for (a, b), p in pages.items()], "src string, dst string, pages long")
    got = {(r["kind"], r["host"]): r["score"] for r in url_trust.propagate(seed_df, edges).collect()}
    for kind in ("trust", "distrust"):
        step = np.zeros((n, n))
        for (a, b), p in pages.items():
            step[(b, a) if kind == "trust" else (a, b)] += p
        step /= np.maximum(step.sum(axis=0), 1)
        base = np.zeros(n)
        for (k, i), s in seeds.items():
            base[i] += 0.15 * s * (k == kind)
        want = base
        for _ in range(200):
            want = base + 0.85 * step @ want
        found = np.array([got.get((kind, f"h{i}"), 0) for i in range(n)])
        assert (found <= want + 1e-6).all() and (want - found < 60 + 0.02 * want).all() and (found > 1000).sum() > 100
