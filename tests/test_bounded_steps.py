import hashlib

from lakeleaf.operators import indexing
from lakeleaf.plans import registry


def test_lines_are_sorted_by_ranges_and_packed(spark):
    """Only packs of lines reach the one task of the digest; equal lines may fill several packs."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).selectExpr("case when id % 3 = 0 then 'same' else concat('k', id % 90) end as key", "cast(if(id % 3 = 0, 1, id) as string) as modified")
        found = indexing.source_hash(df)
        assert "RepartitionByExpression [line" in found._jdf.queryExecution().optimizedPlan().toString()
        lines = sorted(f"{r['key']}|{r['modified']}" for r in df.collect())
        assert found.first()[0] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_reassembled_documents_are_cut_once(spark):
    plan = registry.QUERIES["chunk_reassemble"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("chunk_spans(") == 1
