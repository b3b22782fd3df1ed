from collections import defaultdict

import duckdb
import pytest

from lakeleaf.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Resharing round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: repeats * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000, None: 5}, {"a": 3}, {"x": 0, "y": 50}, {f"s{i:02}": (i * 37) % 90 for i in range(20)}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_odd_rows_equal_sql(spark, odd, none, tmp_path):
    path = str(tmp_path / "documents.parquet")
    odd.select("doc_id", "text", "source").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = sorted(con.sql(mixing.mix_sql()).fetchall(), key=repr)
    got = sorted((tuple(r) for r in mixing.mix(odd).collect()), key=repr)
    assert got == want
    assert mixing.mix(none).count() == 0 and mixing.mix(odd.filter("text is null")).count() == 2


def test_taken_is_near_the_target_and_reruns_agree(spark, small):
    rows = mixing.mix(small).join(small.select("doc_id", "source"), "doc_id").collect()
    per = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] = r["target"]
    assert all(abs(t - target) <= 0.5 for t, target in per.values())
    again = mixing.mix(small.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_tiny_sources_beside_a_huge_one_reach_their_targets(spark):
    rows = [(i, "word " * 40, "huge") for i in range(2000)] + [(10_000 + i, "word " * (1 + i % 3), f"tiny{i % 4}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spanned = mixing.spans(mixing.source_targets(mixing.sized_documents(docs))).collect()
    assert all(r["target"] < mixing.BLOCK and r["blocks"] == 1 for r in spanned if r["source"] != "huge")
    per = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] = r["target"]
    assert len(per) == 5 and all(abs(t - target) <= 0.5 for t, target in per.values())
    kept = {r["source"]: r["count"] for r in mixing.mixed_documents(docs).groupBy("source").count().collect()}
    assert all(kept[f"tiny{k}"] == 18 for k in range(4))


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_the_block_changes_nothing(spark, small, block, monkeypatch):
    whole = sorted((tuple(r) for r in mixing.mix(small).collect()), key=repr)
    monkeypatch.setattr(mixing, "BLOCK", block)
    assert sorted((tuple(r) for r in mixing.mix(small.limit(10_000)).collect()), key=repr) == whole


def test_a_table_above_a_million_words_equals_sql(spark, tmp_path):
    rows = [(i, 30_000, "huge") for i in range(60)] + [(1000 + i, 3, f"tiny{i}") for i in range(5)] + [(2000 + i, 700 * i, None) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string").selectExpr("doc_id", "repeat('w ', n) as text", "source")
    path = str(tmp_path / "documents.parquet")
    docs.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    assert sorted((tuple(r) for r in mixing.mix(docs).collect()), key=repr) == sorted(con.sql(mixing.mix_sql()).fetchall(), key=repr)


@pytest.mark.parametrize("bits", [0, 1, 5, 11, 17])
def test_points_meet_every_number_once(spark, bits):
    n = 1 << bits
    points = [r[0] for r in spark.range(n).selectExpr(f"{mixing.golden('id', bits)} as p").collect()]
    assert sorted(points) == list(range(n))


def test_points_of_the_largest_mix_do_not_overflow(spark):
    g, n = int(2**38 * (5**0.5 - 1) / 2) | 1, 1 << 38
    ids = [0, 1, 65_535, 65_536, n // 3, n - 1]
    got = spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", f"{mixing.golden('id', 38)} as p").collect()
    assert all(r["p"] == r["id"] * g % n for r in got)


def test_schedule_is_spread(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    spanned = mixing.spans(mixing.source_targets(mixing.sized_documents(small)))
    per = {r["source_no"]: r for r in spanned.collect()}
    slots = sorted(mixing.schedule(spanned).collect(), key=lambda s: s["slot"])
    n, seen = 1 << per[0]["bits"], defaultdict(int)
    for s in slots:
        assert s["block"] == seen[s["source_no"]]
        seen[s["source_no"]] += 1
        assert abs(seen[s["source_no"]] - (s["slot"] + 1) * per[s["source_no"]]["blocks"] / n) < 8
    assert seen == {k: r["blocks"] for k, r in per.items() if r["blocks"]} and len(slots) > n / 2


def test_mixed_documents_keep_columns(spark, odd, small):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.filter("text is null").count() == 0
    taken = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(small).collect() if r["size"]}
    counts = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(small).groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in taken.items() if n}


def test_the_main_path_is_native(spark, small):
    import re

    assert not re.search("Python|Pandas|Arrow", mixing.mix(small)._jdf.queryExecution().toString())


def test_sources_are_numbered_by_code_point_null_last(spark):
    names = ["b", "", "a", "ab", "aa", "é", "Z", "漢字", "a b", None, "aab", "aac"]
    df = spark.createDataFrame([(n, 5) for n in names], "source string, size long")
    got = [r["source"] for r in mixing.source_targets(df).orderBy("source_no").collect()]
    assert got == [*sorted(n for n in names if n is not None), None]
