"""Dictionary-compressed WARC writer and reader.

An archive is one ``.warc.zst`` file: a leading skippable frame holds a
Zstandard dictionary built from the archive's own records, and each record
follows as a Zstandard frame of its own, so any record can be read by offset
with only that dictionary.

Equal payloads are stored once: the row with the largest page_id is the
``response``; the others become ``revisit`` records that carry its HTTP header
(and thus the payload's length) and refer to it.

Writing tasks keep at most ``archive_bytes`` of records in memory.  A task
writes each archive under a name of its own attempt and reports it in the
manifest; only archives in the manifest exist for readers, so a task that is
run again after an executor is lost leaves no half-written or doubled archive.

Defined cases: a null html is an empty payload; a null url gives a
``urn:page:`` target; a null page_id is never the response of a group that has
a page_id, and rows that repeat both the payload and the largest page_id are
responses each; an empty table gives no records.  A payload longer than an
archive's bound goes to an archive of its own, so a task's memory is the larger
of the bound and one page.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop, map_batches, scratch, written

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
MANIFEST = "archive string, records long, bytes long"
RECORD = (
    "archive string, offset long, record_type string, page_id long, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<> ").rpartition(":")[2]
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id).strip("<>")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """Fields of one record; a response's digest and length are taken from its payload and must match its headers."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/1.") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return {
        "record_type": kind,
        "page_id": page_of(fields["warc-record-id"]),
        "target_uri": fields["warc-target-uri"],
        "payload_digest": digest,
        "payload_bytes": length,
        "refers_to": page_of(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def train(records: list[bytes], dictionary_bytes: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from evenly spaced records of the archive; a plain content dictionary where there are too few to train on."""
    step = max(1, sum(map(len, records)) // sample_bytes)
    samples = [r[: dictionary_bytes] for r in records[::step]]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-dictionary_bytes:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def encode_archive(records: list[bytes], level: int = 3, dictionary_bytes: int = 32 << 10, sample_bytes: int = 2 << 20) -> bytes:
    dictionary = train(records, dictionary_bytes, sample_bytes)
    stored = dictionary.as_bytes()
    compress = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True).compress
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(stored)), stored, *map(compress, records)])


def decode_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame after the dictionary's."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    stored, at, view = data[8 : 8 + size], 8 + size, memoryview(data)
    trained = stored[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(stored, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    context = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame = context.decompressobj()
        parts, fed = [], at
        while not frame.eof:
            chunk = view[fed : fed + (1 << 16)]
            if not chunk:
                raise ValueError("archive ends inside a record")
            parts.append(frame.decompress(chunk))
            fed += len(chunk)
        end = fed - len(frame.unused_data)
        yield at, b"".join(parts)
        at = end


def store_of(place: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place[5:].lstrip("/")
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def get_file(place: str) -> bytes:
    store, path = store_of(place)
    with store.open_input_stream(path, compression=None) as source:
        return source.read()


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file below a URI or path from an executor."""
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to: the page_id of the response that a row repeats, else null.

    Only digests are grouped (a partial aggregate, so a huge group of copies is cheap).
    The table of repeated digests is checkpointed, which leaves a plain sort-merge join
    whose hot keys AQE splits.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).filter("n > 1 and response_id is not null")
    repeated = checkpoint(groups.select("digest", "response_id"))
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", F.when(~F.col("response_id").eqNullSafe(F.col("page_id")), F.col("response_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 24 << 20, level: int = 3) -> DataFrame:
    """Write every page to archives below a shared folder; returns their manifest (archive, records, bytes), which is the commit."""

    def archives(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def flush() -> pa.RecordBatch:
            data = encode_archive(held, level)
            name = f"{uuid.uuid4().hex}.warc.zst"
            row = {"archive": [put_file(folder, name, data)], "records": [len(held)], "bytes": [len(data)]}
            held.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                record = encode_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), refers_to.is_valid)
                if held and size + len(record) > archive_bytes:
                    yield flush()
                    size = 0
                held.append(record)
                size += len(record)
        if held:
            yield flush()

    return written(map_batches(with_revisits(pages), archives, MANIFEST))


def read_archives(manifest: DataFrame, archives_a_task: int = 2) -> DataFrame:
    """All records of the archives in the manifest (schema RECORD); a task reads about two archives, one at a time."""

    def records(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in RECORD.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for offset, record in decode_archive(get_file(path)):
                    rows.append({"archive": path, "offset": offset} | decode_record(record))
                    size += len(record)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # A given number of partitions, so that adaptive execution does not merge them by the few bytes of the paths.
    archives = manifest.count()
    spread = manifest.select("archive").repartition(max(1, -(-archives // archives_a_task)), "archive")
    return map_batches(spread, records, RECORD)


def archive_round_trip(pages: DataFrame, archive_bytes: int = 24 << 20) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What was read is a written table without payloads, so the archives, which are
    of no more use, and those of attempts that were run again, are removed.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    manifest = write_archives(pages, folder, archive_bytes)
    out = written(read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    drop(spark, folder)
    return out


def archive_round_trip_sql() -> str:
    """DuckDB SQL for ``archive_round_trip``; base32 takes four digits from every five hexadecimal ones."""
    digit = "(('0x' || substr(x, 5 * (i // 4) + 1, 5))::bigint >> (5 * (3 - i % 4))) & 31"
    digest = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ({digit}) as bigint), 1)), '')"
    return f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as x from p),
g as (select *, max(page_id) over (partition by x) as m from d),
r as (select *, case when m is not null and page_id is distinct from m then m end as refers_to from g)
select page_id, payload_bytes, {digest} as payload_digest, if(refers_to is null, 'response', 'revisit') as record_type, refers_to from r"""
