import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeleaf.llm import packing as pk
from lakeleaf.llm.queries import QUERIES, tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ,.'s\n\té漢<|>5 ", max_size=40), min_size=1, max_size=5))
def test_cached_ids_equal_the_library(texts):
    got = pk.tokenizer_of(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == plain_ids(texts)


def test_ids_of_documents(small):
    texts = [r["text"] for r in small.collect()]
    got = pk.CachedTokenizer(PATH, cache_bytes=50_000).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == plain_ids(texts)


def test_ids_of_an_arrow_slice_with_nulls():
    import pyarrow as pa

    texts = ["left out", None, "", " lead", "a  b", "end ", "one\ntwo. three,", "x" * 90 + " y", "漢 字", "left out"]
    got = pk.CachedTokenizer(PATH, cache_bytes=1 << 20).encode(pa.array(texts).slice(1, 8))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == plain_ids([t or "" for t in texts[1:9]])


def check(df, pieces):
    """Every id in one piece, sequences gapless and within the capacity."""
    rows = [r.asDict() for r in pieces.collect()]
    docs = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    want = sorted((repr(d), tuple(ids) + (pk.END_ID,)) for (d, _), ids in zip(docs, plain_ids([t for _, t in docs]), strict=True))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(ids) == r["length"] > 0
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    count, built = defaultdict(int), defaultdict(int)
    for d, ids in want:
        for i, x in enumerate(ids):
            count[d, i, x] += 1
    for (d, _), ps in parts.items():
        for start, ids in ps:
            for i, x in enumerate(ids, start):
                built[repr(d), i, x] += 1
    assert count == built
    for seq in sequences.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 2048
    padded = {r["sequence_id"]: r["padded_length"] for r in rows}
    return sum(padded.values()), sum(r["length"] for r in rows)


def test_packs_every_id(spark, small, odd, none):
    for df in (small, odd, small.repartition(5)):
        padded, tokens = check(df, pk.pack(df, PATH))
        assert padded <= 1.03 * tokens
    assert pk.pack(none, PATH).count() == 0


def test_classes_take_a_fixed_count():
    packer = pk.HarmonicPacker(slack=1.0)  # no cuts
    rng, seqs = np.random.default_rng(1), []
    for i in range(3000):
        seqs += packer.add(i, bytes(4 * int(rng.integers(1, 2049))))
    for _, pieces in seqs:
        lengths = [len(p[2]) // 4 for p in pieces]
        assert {2048 // n for n in lengths} == {len(pieces)} and sum(lengths) <= 2048
    tail = [sum(len(p[2]) // 4 for p in pieces) for _, pieces in packer.finish()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in tail)


def test_query_digests(spark):
    rows = QUERIES["op9_harmonic_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows[:50]:
        ids = (plain_ids([docs[r["doc_id"]]])[0] + [1])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_texts_without_spaces_fill_no_cache():
    """Long runs without spaces (CJK, base64) are encoded but not kept."""
    encoder = pk.CachedTokenizer(PATH, cache_bytes=1 << 20)
    rng = np.random.default_rng(5)
    texts = ["".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 5000, 3000)) for _ in range(12)] + [f"plain {'x' * 500}{i} words" for i in range(12)]
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == plain_ids([t])[0]
    held = [k for cache in (encoder.known, encoder.heads) for part in (cache.young, cache.old) for k in part if k not in cache.passing]
    assert max(map(len, held)) <= 64 and sum(len(k) + pk.RecentCache.ENTRY for k in held) <= 1 << 20
