import base64
import hashlib

import pytest

from lakeleaf.llm import warc

ROWS = [(1, "http://a/x y\n", "same"), (5, None, "same"), (3, "http://b", "same"), (2, "http://c", None), (4, "u", ""), (None, "v", "same"), (None, "w", "lone"), (7, "z", "é" * 5000), (8, "z", "twice"), (8, "z", "twice")]


def test_round_trip_of_odd_rows(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as digest", "2 as refers_to")
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages, archive_bytes=4000).collect()), key=repr)
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        top = max((p for p, _, h in ROWS if p is not None and (h or "") == (html or "")), default=None)
        revisit = top is not None and page != top
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archive_format_and_payloads(spark):
    records = [warc.encode_record(i, f"http://h/{i}", f"<html>{'text ' * (i % 50)}{i}</html>".encode(), None, False) for i in range(500)]
    data = warc.encode_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    found = list(warc.decode_archive(data))
    assert [r for _, r in found] == records
    assert len(data) < sum(map(len, records)) / 3
    # Any record can be read by its offset with the dictionary alone.
    size = int.from_bytes(data[4:8], "little")
    import zstandard

    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert context.decompressobj().decompress(data[found[123][0] :]) == records[123]


def test_damage_is_found():
    record = warc.encode_record(1, "u", b"payload", None, False)
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(record.replace(b"payload", b"PAYLOAD"))
    with pytest.raises(ValueError):
        list(warc.decode_archive(warc.encode_archive([record])[:-3]))


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.archive_round_trip(pages).collect()
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert {r["page_id"]: r["payload_bytes"] for r in rows} == {k: len(v) for k, v in html.items()}
