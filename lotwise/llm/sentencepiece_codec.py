"""SentencePiece encoding and decoding on the tokenizers library (operator 9).

The model file (a protobuf) is parsed here: pieces with scores and types, the
kind of model, and the normaliser's settings. From these a ``Tokenizer`` is
rebuilt: normaliser (precompiled character map, white space, the metaspace
marker for spaces, the dummy prefix), unigram scores or the merges that a BPE
model's scores imply, byte fallback, and the decoder.

Where no piece has a marker after another character, or holds a line feed
beside others, text falls into units at these places that are encoded on their
own. Tasks then encode each distinct unit (told apart by its bytes) once, in
multithreaded batches, and hold its ids against the sentencepiece library's and
its decoded bytes against the rebuilt decoder's. Parity of a text is therefore
that of its units, not of the whole text in one call. The rebuilt normaliser runs
for other models only, whose parity is that of whole texts. Rows are put together
from a table of the pieces' bytes and held against the text (round_trip).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import text_batches
from .textkit import SpanNumbers, kept, text_slices

MARK = "▁"
#: Parts the units of a batch; encoded as one byte-fallback token, which is then dropped.
_SEAM = "\x01"
_JOINED = 2000
_KEEP_UNITS = 1_500_000

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields: int, bytes, or float for 32-bit ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError(f"wire type {kind} in a SentencePiece model")


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece[1].decode("utf-8"))
                model.scores.append(piece.get(2, 0.0))
                model.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(_fields(value))
                model.charsmap = norm.get(2, b"")
                model.dummy_prefix, model.squeeze_spaces, model.escape_spaces = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        return model

    @property
    def unknown_id(self) -> int:
        return self.types.index(UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two others, best-scored piece first."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        made = [(-self.scores[i], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(a, b) for *_, a, b in sorted(made)]

    def units_part(self) -> bool:
        """Whether texts may be cut before a run of markers and around a line feed."""
        plain = not self.charsmap and self.escape_spaces and self.dummy_prefix and not self.squeeze_spaces
        usual = [p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER)]
        return plain and self.byte_fallback and self.kind == BPE and not any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") or (_SEAM in p and p != _SEAM) for p in usual)


def build_tokenizer(model: PieceModel, seams: bool = False):
    """A ``tokenizers.Tokenizer`` equal to the model; with ``seams`` one for escaped units joined by _SEAM."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == BPE:
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, model.merges(), unk_token=model.pieces[model.unknown_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), model.unknown_id, model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are handled")
    out = Tokenizer(core)
    if seams:
        out.pre_tokenizer = pre_tokenizers.Split(_SEAM, "isolated")
        return out
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return out


def unit_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units, and the index of each row's first: a unit begins at a row's begin, at a run of spaces, at a line feed and after one. A row that spells the marker itself is one unit."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space, feed = data == 32, data == 10
    begin = space | feed
    begin[1:] &= ~(space[1:] & space[:-1])
    begin[1:] |= feed[:-1]
    spelt = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    for row in np.unique(np.searchsorted(offsets, spelt, "right") - 1).tolist():
        begin[offsets[row] : offsets[row + 1]] = False
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class Codec:
    """Encodes and decodes rows of UTF-8 texts."""

    def __init__(self, path: str) -> None:
        task = TaskContext.get()
        threads = task.cpus() if task else 1  # a task's share of its executor
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            self.model = PieceModel.parse(f.read())
        self.threads = threads
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_units = self.model.units_part()
        self.tokenizer = build_tokenizer(self.model, seams=self.by_units)
        self.whole = build_tokenizer(self.model)
        self.seam = self.tokenizer.encode(_SEAM, add_special_tokens=False).ids if self.by_units else []
        if len(self.seam) != 1:
            self.by_units = False
            self.tokenizer = self.whole
        plain = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.model.pieces, self.model.types, strict=True)]
        self.piece_at = np.concatenate(([0], np.cumsum([len(p) for p in plain])))
        self.piece_bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.numbers = SpanNumbers(_KEEP_UNITS)
        self._forget()

    def _forget(self) -> None:
        self.numbers.clear()
        self.places, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.equal, self.ids = np.zeros(0, bool), np.zeros(0, np.uint32)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, number of ids, and parity of each unit (with spaces as they are)."""
        marked = [u.replace(" ", MARK) for u in units]
        apart = [i for i, u in enumerate(marked) if _SEAM in u]
        if apart:
            lists = [e.ids for e in build_tokenizer_cached(self).encode_batch_fast(marked, add_special_tokens=False)]
        else:
            texts = [_SEAM.join(marked[i : i + _JOINED]) + _SEAM for i in range(0, len(marked), _JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            seams = np.flatnonzero(ids == self.seam[0])
            ids, sizes = np.delete(ids, seams), np.diff(np.concatenate(([-1], seams))) - 1
            if len(sizes) != len(units):
                raise ValueError("units didn't stay apart")
        if apart:
            ids, sizes = np.array([i for row in lists for i in row], np.uint32), np.array([len(row) for row in lists])
        # behind a line feed, whose two ids are cut off, a unit is as inside a text
        want = [row[2:] for row in self.reference.encode(["\n" + u for u in units], num_threads=self.threads)]
        flat = np.array([i for row in want for i in row], np.uint32)
        want_sizes = np.array([len(row) for row in want])
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        if len(flat) == len(ids) and (flat == ids).all() and (want_sizes == sizes).all():
            equal = np.ones(len(units), bool)
        else:
            equal = np.array([ids[a:b].tolist() == row for a, b, row in zip(ends[:-1].tolist(), ends[1:].tolist(), want, strict=True)], bool)
        return ids, sizes, equal & self._decoded_alike(ids, ends)

    def _decoded_alike(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether the rebuilt decoder gives each row the bytes that :meth:`decode` gives it."""
        rows = [ids[a:b].tolist() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        own, cuts = self.decode(ids, begin)
        theirs = self.whole.decode_batch(rows, skip_special_tokens=False)
        return np.array([own[a:b].decode("utf-8", "replace") == t for a, b, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), theirs, strict=True)], bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, where each row begins, and each row's parity. A row without bytes has no ids."""
        n = len(offsets) - 1
        if not self.by_units:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            got = [e.ids if t else [] for e, t in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]
            want = self.reference.encode(texts, num_threads=self.threads)
            ids, begin = np.array([i for row in got for i in row], np.uint32), np.concatenate(([0], np.cumsum([len(r) for r in got]))).astype(np.int64)
            return ids, begin, np.array([a == b for a, b in zip(got, want, strict=True)], bool) & self._decoded_alike(ids, begin)
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        starts, ends, first = unit_spans(data, offsets)
        if self.numbers.full(len(starts)):
            self._forget()
        number, new = self.numbers(data, starts, ends)
        if len(new):
            raw = data.tobytes()
            ids, sizes, equal = self._encode_units([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.places = np.concatenate((self.places, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.equal = np.concatenate((self.equal, equal))
            self.ids = np.concatenate((self.ids, ids))
        sizes = self.sizes[number]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(begin[-1]) + np.repeat(self.places[number] - begin[:-1], sizes)]
        wrong = np.concatenate(([0], np.cumsum(~self.equal[number])))
        return ids, begin[first], wrong[first[1:]] == wrong[first[:-1]] if n else np.zeros(0, bool)

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 bytes of all rows, and where each begins; the dummy prefix's space is dropped."""
        sizes = np.diff(self.piece_at)[ids]
        at = np.concatenate(([0], np.cumsum(sizes)))
        out = self.piece_bytes[np.arange(at[-1]) + np.repeat(self.piece_at[ids] - at[:-1], sizes)]
        rows = at[begin]
        if self.model.dummy_prefix:
            lead = rows[:-1][np.diff(rows) > 0]
            lead = lead[out[lead] == 32]
            out = np.delete(out, lead)
            rows = rows - np.searchsorted(lead, rows)
        return out.tobytes(), rows


def build_tokenizer_cached(codec: Codec):
    """For units that hold the seam: the same model without seams."""
    if not hasattr(codec, "alone"):
        codec.alone = build_tokenizer(codec.model, seams=True)
        codec.alone.pre_tokenizer = None
    return codec.alone


def codec_of(path: str) -> Codec:
    """The codec of this Python worker."""
    return kept(f"codec {path}", lambda: Codec(path))


def sentencepiece_codec(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_ids, ids_crc32, decoded_bytes, decoded_crc32, round_trip, parity, and ids if asked for.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers.
    round_trip: whether decoding gives the text back, byte for byte; parity:
    whether the sentencepiece library gives the same ids and the rebuilt decoder
    the same text (for each unit, where a text falls into units). A null or empty text has no ids, a null
    doc_id stays null, and repeated rows stay. Very long texts are encoded whole,
    an empty table gives no rows, and other columns are ignored, whatever their names.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_bytes long, decoded_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * ids
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1), 3 << 20):
                found, begin, parity = codec.encode(data, offsets)
                text, rows = codec.decode(found, begin)
                raw, encoded = data.tobytes(), found.astype("<u4").tobytes()
                ends, cuts = offsets.tolist(), rows.tolist()
                spans = begin.tolist()
                columns = [
                    batch.column(0).slice(at, to - at),
                    pa.array(np.diff(begin)),
                    pa.array([zlib.crc32(encoded[4 * a : 4 * b]) for a, b in zip(spans[:-1], spans[1:], strict=True)], pa.int64()),
                    pa.array(np.diff(rows)),
                    pa.array([zlib.crc32(text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                    pa.array([raw[a:b] == text[c:d] for a, b, c, d in zip(ends[:-1], ends[1:], cuts[:-1], cuts[1:], strict=True)], pa.bool_()),
                    pa.array(parity, pa.bool_()),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return text_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec(spark.read.parquet(f"{sf_dir}/documents.parquet"))
