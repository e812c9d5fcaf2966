"""Media columns from ISO media containers (operator 8).

A reader walks the nested boxes of an ISO base media file, decodes the sample
tables of its first track that has samples and gives codec, duration and the byte ranges of the
keyframes; it never decodes samples. A writer stores bytes losslessly as
uncompressed 24 x 24 grey frames (one byte a pixel, 576 a frame).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import scratch, text_batches
from .textkit import text_slices

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
#: Every so many frames one is marked as a keyframe, and a chunk begins.
KEY_EVERY = 12
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta"}
_MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_media(payload: bytes) -> bytes:
    """A container with ``payload`` (a positive multiple of FRAME bytes) as frames."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError(f"a payload must be a positive multiple of {FRAME} bytes")
    chunks = -(-n // KEY_EVERY)
    last = n - (chunks - 1) * KEY_EVERY
    runs = [(1, KEY_EVERY, 1), (chunks, last, 1)] if chunks > 1 and last != KEY_EVERY else [(1, min(n, KEY_EVERY), 1)]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    tables = [
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", chunks), np.arange(1, n + 1, KEY_EVERY, dtype=">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
    ]
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    wide = len(payload) + 64 * chunks + 4096 >= 1 << 32

    def movie(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.uint64) * np.uint64(KEY_EVERY * FRAME)
        places = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", *tables, places)),
        )
        header = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 1 << 16, 1 << 8), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)), _box(b"trak", header, media))

    lead = 16 if wide else 8
    return kind + movie(len(kind) + len(movie(0)) + lead) + _box(b"mdat", payload)


def boxes(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, start and end of the body) of every box, nested ones after their parent."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from boxes(data, start + head, start + size, (*path, kind))
        start += size


def media_tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """For each track, where the bodies of its boxes lie (the first of each kind)."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in boxes(data):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], (a, b))
    return tracks


def read_media(data: bytes) -> dict:
    """codec, timescale, duration, and offset, size and keyframe numbers of the samples of the first track that has samples.

    Raises ValueError for data without such a track, or cut short.
    """
    try:
        tracks = media_tracks(data)
        track = next((t for t in tracks if struct.unpack_from(">I", data, t[b"stsz"][0] + 8)[0]), tracks[0]) if tracks else None
        if track is None:
            raise ValueError("no track")
        return _sample_tables(data, track)
    except (KeyError, IndexError, struct.error) as wrong:
        raise ValueError(f"not a whole media file: {wrong!r}") from wrong


def _sample_tables(data: bytes, track: dict[bytes, tuple[int, int]]) -> dict:
    def table(kind: bytes, dtype: str, skip: int, columns: int = 1) -> np.ndarray:
        a, b = track[kind]
        (n,) = struct.unpack_from(">I", data, a + skip - 4)
        if a + skip + n * columns * np.dtype(dtype).itemsize > b:
            raise ValueError(f"table {kind!r} leaves its box")
        return np.frombuffer(data, dtype, n * columns, a + skip).astype(np.int64).reshape(n, columns)

    at = track[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ" if data[at] == 1 else ">II", data, at + (20 if data[at] == 1 else 12))
    codec = bytes(data[track[b"stsd"][0] + 12 : track[b"stsd"][0] + 16]).decode("latin-1")
    uniform, n = struct.unpack_from(">II", data, track[b"stsz"][0] + 4)
    sizes = np.full(n, uniform, np.int64) if uniform else table(b"stsz", ">u4", 12)[:, 0]
    places = (table(b"co64", ">u8", 8) if b"co64" in track else table(b"stco", ">u4", 8))[:, 0]
    runs = table(b"stsc", ">u4", 8, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(places) + 1)))
    if len(per_chunk) != len(places) or per_chunk.sum() < n or not timescale:
        raise ValueError("the sample tables don't fit together")
    first = np.concatenate(([0], np.cumsum(per_chunk)))[:-1]
    before = np.concatenate(([0], np.cumsum(sizes)))
    chunk = np.repeat(np.arange(len(places)), per_chunk)[:n]
    offsets = places[chunk] + before[:-1] - before[first[chunk]]
    keys = table(b"stss", ">u4", 8)[:, 0] - 1 if b"stss" in track else np.arange(n)
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data) or not len(keys) or keys.min() < 0 or keys.max() >= n):
        raise ValueError("a sample lies outside the file")
    return {"codec": codec, "timescale": timescale, "duration": duration, "offsets": offsets, "sizes": sizes, "keys": keys[: n or None]}


def stored_payload(data: bytes, media: dict) -> bytes:
    """All samples, in order."""
    a, n = media["offsets"], media["sizes"]
    if len(a) and (a[1:] == a[:-1] + n[:-1]).all():
        return data[int(a[0]) : int(a[-1] + n[-1])]
    return b"".join(data[x : x + y] for x, y in zip(a.tolist(), n.tolist(), strict=True))


def keyframe_at(media: dict, second: float) -> int:
    """Number of the keyframe to start from, so as to show what stands at ``second``."""
    keys = media["keys"].tolist()
    return keys[max(0, bisect_right(keys, int(second * media["timescale"])) - 1)]


def store_documents(docs: DataFrame, path: str) -> None:
    """Write doc_id, n_bytes and the media file of each text (null: empty) as Parquet."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1)):
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                files = [write_media(t + b"\xff" * (-len(t) % FRAME or (0 if t else FRAME))) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    text_batches(docs.select("doc_id", "text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)


def media_columns(files: DataFrame) -> DataFrame:
    """Columns of each ISO media file in ``media``, beside doc_id and n_bytes of ``files``.

    A null file has null columns. So has one that is empty, cut short or without
    a track, and ``error`` says what is wrong with it; else ``error`` is null.
    Of several tracks the first that has samples counts, with its own tables.
    Very long files are read whole, repeated rows stay, an empty table gives no
    rows, and other columns are ignored, whatever their names.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "codec string, duration_s double, keyframes array<struct<offset: long, length: long>>, error string"
    )
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for cell in batch.column(2):
                data = cell.as_py()
                if data is None:
                    rows.append((None,) * 10)
                    continue
                try:
                    media = read_media(data)
                except ValueError as wrong:
                    rows.append((None,) * 9 + (str(wrong),))
                    continue
                payload = stored_payload(data, media)
                keys = media["keys"]
                spans = [{"offset": a, "length": n} for a, n in zip(media["offsets"][keys].tolist(), media["sizes"][keys].tolist(), strict=True)]
                seconds = media["duration"] / media["timescale"]
                last = f"{spans[-1]['offset']}+{spans[-1]['length']}" if spans else ""
                feature = f"codec={media['codec'].strip()};samples={len(media['sizes'])};seconds={seconds:.2f};keyframes={len(spans)};last={last}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, media["codec"], seconds, spans, None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranges, pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in schema.replace("array<struct<offset: long, length: long>>", "x").split(", ")])

    return text_batches(files.select("doc_id", "n_bytes", "media")).mapInArrow(read, schema)


def document_media(docs: DataFrame) -> DataFrame:
    """Store every text as a media file in the shared folder and describe the files as they read back.

    One row per row of ``docs`` (doc_id, text). A null or empty text is one
    frame of bytes 255; equal texts give equal values; a null doc_id stays null.
    """
    spark = docs.sparkSession
    path = scratch(spark, "media")
    store_documents(docs, path)
    return media_columns(spark.read.parquet(path))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
