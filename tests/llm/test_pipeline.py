from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from lakeleaf.llm import line_crf, mixing, packing, toxicity
from lakeleaf.llm.queries import tokenizer_file
from tests.llm.conftest import odd_documents
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_equals_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if (model if isinstance(model, float) else model.score(r[1])) < 0.3]
    field = line_crf.fit_field(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if line_crf.judge(r[1], field)[6]]
    verdicts = brute([r[:2] for r in rows], 5, 80)
    rows = [r for r in rows if verdicts[r[0]][1] == r[0]]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    times = {r[0]: int(r[4] / r[1] + 0.5) for r in con.sql(mixing.mix_sql()).fetchall() if r[1]}
    texts = {d: t for d, t, _ in rows}
    encoder = packing.CachedTokenizer(tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for d, n in times.items():
        ids = np.frombuffer(encoder.encode([texts[d]])[0], "<u4").tolist() + [packing.END_ID]
        for i, x in enumerate(ids):
            want[d, i, x] += n
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        for i, x in enumerate(np.frombuffer(r["ids"], "<u4").tolist(), r["start"]):
            got[r["doc_id"], i, x] += 1
    assert +got == +want and sum(want.values()) > 10_000


def test_stages_take_odd_rows(spark, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        n = None
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, path)
            if i < 4:
                assert tuple(out.columns) == corpus_pipeline.COLUMNS
            place = f"{path}/{i}-{n is None}-{docs.count()}"
            out.write.parquet(place)
            docs, n = spark.read.parquet(place), 1


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-dedup", "mixing", "packing"]
