"""WARC archives with a dictionary of their own (operator 2).

Pages with equal payloads are stored once: the others are revisit records. The
records of an archive are compressed one by one with a Zstandard dictionary
trained on records of that archive; the dictionary stands in a skippable frame
at the archive's start, so each record can be read by its offset alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, small, stored, tasks_for, text_batches

#: Marks a skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on records of about so many bytes in all, taken evenly over the archive.
TRAIN_BYTES = 100 * DICTIONARY_BYTES
#: An archive is closed when its records reach this size.
ARCHIVE_BYTES = 24 << 20
#: Payloads from this size on are stored once.
REVISIT_FROM = 1000
LEVEL = 3

_DAY = "2024-01-01T00:00:00Z"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: the response, or where ``refers_to`` is set a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DAY}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> tuple[bytes, list[int]]:
    """An archive and the offset of each record's frame.

    An archive of fewer than eight records, or of too few bytes to train on, has
    no dictionary: the library can't build one from these.
    """
    total = sum(map(len, records))
    step = max(1, -(-total // TRAIN_BYTES))
    samples = [r[: DICTIONARY_BYTES * 4] for r in records[::step]]
    dictionary, lead = None, b""
    if len(samples) >= 8 and sum(map(len, samples)) > 8 * 1024:
        try:
            size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8))
            dictionary = zstandard.train_dictionary(size, samples, k=256, d=8)
        except zstandard.ZstdError:  # records too alike or too short to train on
            dictionary = None
    if dictionary is not None:
        raw = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        lead = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    parts, offsets, at = [lead], [], len(lead)
    for record in records:
        frame = press.compress(record)
        offsets.append(at)
        parts.append(frame)
        at += len(frame)
    return b"".join(parts), offsets


def archive_opener(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """What opens the archive's frames, and the offset of the first."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return zstandard.ZstdDecompressor(), 0
    (size,) = struct.unpack_from("<I", data, 4)
    raw = data[8 : 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), 8 + size


def parsed_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers with lower-case names, and the block, of one record."""
    head, _, block = record.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return headers, block[: int(headers["content-length"])]


def read_archive(data: bytes, offsets: list[int] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose frames begin at ``offsets``, or of all records of the archive in order."""
    opener, at = archive_opener(data)
    view = memoryview(data)
    if offsets is not None:
        for a in offsets:  # a frame knows its record's size and its own end
            yield parsed_record(opener.decompress(view[a:], allow_extra_data=True))
        return
    step = 1 << 16
    while at < len(data):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(view[at : at + step]))
            at = min(at + step, len(data))
        at -= len(frame.unused_data)
        yield parsed_record(b"".join(parts))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the page whose equal payload is stored; null where this one is)."""
    body = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    light = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    large = light.where((F.col("size") >= REVISIT_FROM) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    # ids and digests only: copies of one page meet their response without payloads, and payloads are joined by page, of which none is frequent
    revisits = stored(large.select("page_id", "digest").join(first, "digest").where("response != page_id").select("page_id", "digest", F.col("response").alias("refers_to")).distinct(), "revisits")
    own = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha1("payload"))
    return own.join(small(revisits), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for the folder's URI, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` (any file system that pyarrow opens by URI) and return their index.

    The index has archive, record_offset, page_id. Each task writes its rows'
    archives under a name of its own attempt; only files in the index, which
    Spark writes for the attempt that counts, belong to the result.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = opened(folder)
        held: list[bytes] = []
        ids: list[int | None] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            data, offsets = archive_bytes(held)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(offsets, pa.int64()), pa.array(ids, pa.int64())], names=["archive", "record_offset", "page_id"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                held.append(warc_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                ids.append(page_id.as_py())
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, ids, size, number = [], [], 0, number + 1
        if held:
            yield close()

    return stored(text_batches(with_revisits(pages)).mapInArrow(write, "archive string, record_offset long, page_id long"), "warc-index")


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """A row per record of the archives in the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for a revisit)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def number(record_id: str) -> int | None:
        digits = record_id[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in schema.split(", ")]
        store, base = opened(folder)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with store.open_input_file(f"{base}/{name}") as f:
                    data = f.read()
                for headers, block in read_archive(data, offsets):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {headers['warc-record-id']} doesn't hold what was stored")
                    of = number(headers["warc-refers-to"]) if revisit else None
                    rows.append((number(headers["warc-record-id"]), length, digest, headers["warc-type"], of, headers["warc-target-uri"], None if revisit else payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    # an archive has at most ARCHIVE_BYTES of records and one more, so its list of offsets is short; only names and offsets are shuffled
    records = index.groupBy("archive").agg(F.array_sort(F.collect_list("record_offset")).alias("offsets"))
    return records.repartition(tasks_for(spark), "archive").mapInArrow(read, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write a WARC record for each row of ``pages`` (page_id, url, html), read the archives back, and describe the records.

    A null html is an empty payload, a null url ``about:blank``. Of equal
    payloads of REVISIT_FROM bytes or more the row with the largest page_id is
    the response; rows that repeat that page_id are responses too. A null
    page_id stays null and is always a response. A payload of any length is one
    record, an empty table gives no rows, and other columns are ignored, whatever
    their names.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    index = write_archives(pages.select("page_id", "url", "html"), folder)
    if index.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    return read_archives(spark, folder, index).drop("payload")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), r AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN r USING (payload_digest)
"""
