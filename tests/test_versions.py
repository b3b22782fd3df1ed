"""The table of versions against a plain dictionary."""

import random

import pytest

from lakeleaf.sources.versions import VersionedTable

SCHEMA = "k int, day string, text string, at int"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/table", ["k", "day"])


def held(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2:] for r in rows}


def greatest(rows):
    low = lambda v: (v is not None, v if v is not None else 0)
    out = {}
    for k, day, text, at in rows:
        best = out.get((k, day))
        if best is None or (low(at), (text is not None, text or "")) > (low(best[1]), (best[0] is not None, best[0] or "")):
            out[k, day] = (text, at)
    return out


def some(rng, n, keys):
    pick = lambda *v: rng.choice(v)
    return [(pick(None, *keys), pick(None, "a", "b"), pick(None, "", "x", "y" * 50), pick(None, 1, 2, 3)) for _ in range(n)]


def test_equals_a_dictionary(spark, table):
    rng = random.Random(4)
    rows = some(rng, 400, range(100))
    want = {1: greatest(rows)}
    assert table.save(spark.createDataFrame(rows, SCHEMA), ["at"], rows_per_bucket=10) == 1
    rows = some(rng, 60, range(70, 120))
    want[2] = want[1] | greatest(rows)
    assert table.upsert(spark.createDataFrame(rows, SCHEMA), ["at"]) == 2
    gone = {(k, day) for k, day, *_ in some(rng, 40, range(110))}
    want[3] = {k: v for k, v in want[2].items() if k not in gone}
    assert table.remove(spark.createDataFrame(sorted(gone, key=repr), "k int, day string")) == 3
    want[4] = want[1]
    assert table.restore(1) == 4
    assert table.versions() == [1, 2, 3, 4]
    assert {v: held(table.read(v)) for v in want} == want
    table.forget(2)
    assert table.versions() == [3, 4] and held(table.read(3)) == want[3] and held(table.read()) == want[4]
    with pytest.raises(ValueError):
        table.read(1)


def test_only_touched_buckets_are_rewritten(spark, table):
    table.save(spark.createDataFrame([(i, "a", "x", 0) for i in range(1000)], SCHEMA), rows_per_bucket=50)
    before = table.entry()["folders"]
    assert 10 <= len(before) <= 21
    table.upsert(spark.createDataFrame([(i, "a", "z", 1) for i in range(500, 510)], SCHEMA))
    after = table.entry()
    changed = {b for b in before if before[b] != after["folders"][b]}
    assert 1 <= len(changed) <= 2 and set(after["rewritten"]) == changed
    found = held(table.read())
    assert len(found) == 1000 and sum(v == ("z", 1) for v in found.values()) == 10


def test_a_killed_commit_leaves_the_version_before(spark, table, monkeypatch):
    table.save(spark.createDataFrame([(1, "a", "x", 0), (2, "a", "x", 0)], SCHEMA))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_rename", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(spark.createDataFrame([(1, "a", "new", 1)], SCHEMA))
    assert table.versions() == [1] and held(table.read()) == {(1, "a"): ("x", 0), (2, "a"): ("x", 0)}
    assert table.upsert(spark.createDataFrame([(1, "a", "new", 1)], SCHEMA)) == 2


def test_of_two_commits_on_a_version_the_second_fails(spark, table):
    table.save(spark.createDataFrame([(1, "a", "x", 0)], SCHEMA))
    entry = table.entry()
    table.restore(1)
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit(2, entry, "restore", [])
    assert table.entry(2)["action"] == "restore" and table.versions() == [1, 2]


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    table.save(none)
    assert table.read().collect() == []
    table.upsert(none)
    table.remove(none)
    table.upsert(spark.createDataFrame([(None, None, None, None)], SCHEMA))
    assert held(table.read()) == {(None, None): (None, None)}
