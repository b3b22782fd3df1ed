import pytest

from lakeleaf.llm import common


def test_slices_hold_few_bytes_and_all_rows():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 500, "", "é" * 40, "c" * 10, "d"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "t"])
    for view in (batch, batch.slice(3, 20)):
        for rows, most in ((4, 100), (100, 60), (3, 10**6)):
            parts = list(common.slices(view, 1, rows, most))
            assert sum((p.column(0).to_pylist() for p in parts), []) == view.column(0).to_pylist()
            assert all(p.num_rows <= rows for p in parts)
            assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= most for p in parts)


def test_the_cache_is_bounded_and_right():
    asked = []
    cache = common.RecentCache(limit=20 * (common.RecentCache.ENTRY + 8), longest=9)
    compute = lambda new: asked.extend(new) or {k: len(k) * 3 for k in new}
    for i in range(300):
        keys = {f"key{i % 40}", f"key{i % 3}", "long" * 20}
        got = cache.lookup(keys, compute)
        assert {k: got[k] for k in keys} == {k: len(k) * 3 for k in keys}
        assert len(cache.young) + len(cache.old) <= 26
    assert asked.count("long" * 20) == 300 and asked.count("key1") < 30


def test_scratch_folders_go(spark):
    import os

    path = common.scratch(spark, "test")
    spark.range(3).write.parquet(f"{path}/rows")
    assert os.path.isdir(path.removeprefix("file:"))
    common.drop(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session())
