"""Cross-tokenizer alignment as an event sweep (operator 11).

Every token of a text ends at a byte offset. The end events of two tokenizers,
A (byte-level BPE) and B (SentencePiece), are united, partitioned by document
and sorted by offset, and a machine streams through them:

* where both end, a group ends: the A and B tokens since the last such offset;
* every end of either is the end of a stretch that lies in one A and one B
  token, so that each distinct end is exactly one link, a pair of overlapping
  tokens.

The machine's state is the tokens behind the last common end and the open
document's sums. Events travel in blocks of up to BLOCK tokens of one side
with the block's offset, as ids alone: a token's bytes, and so its end, follow
from its id. A task encodes a text's units (cut where neither tokenizer joins)
once for each distinct unit, told apart by its bytes.

How many documents hold an id pair linked, and which is each A id's highest,
is counted by Spark over the stored links. The most frequent pairs are
broadcast, at most FREQUENT; links of the others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sentencepiece_codec import MARK, Codec
from .shared import BROADCAST_ROWS, stored, tasks_for, text_batches
from .textkit import SpanNumbers, kept, text_slices

#: Tokens in a block of events.
BLOCK = 4096
#: Pairs whose counts are broadcast, at most.
FREQUENT = BROADCAST_ROWS
#: Tokens that the machine takes in at once.
STEP = 400_000
#: A document's number and an offset share a 64-bit word.
_OFFSET_BITS = 40
_KEEP_UNITS = 1_500_000


def default_files() -> tuple[str, str]:
    """The files of A and B that are used if the caller names none."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for letters from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def byte_level_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = _byte_letters()
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


def sentencepiece_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a SentencePiece model: the marker as a space, <0xHH> as a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]


@lru_cache(maxsize=4)
def _tables(a_path: str, b_path: str) -> tuple[list[bytes], list[bytes]]:
    return byte_level_pieces(a_path), sentencepiece_pieces(b_path)


class Pieces:
    """Bytes of token ids, row by row."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether the ids of each row spell its bytes."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = self.data[np.arange(ends[-1]) + np.repeat(self.at[ids] - ends[:-1], sizes)]
        rows = ends[begin]
        if np.array_equal(rows, offsets) and np.array_equal(out, data):
            return np.ones(len(offsets) - 1, bool)
        mine, theirs = out.tobytes(), data.tobytes()
        spans = zip(rows[:-1].tolist(), rows[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return np.array([mine[a:b] == theirs[c:d] for a, b, c, d in spans], bool)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units of A begin: at a row's begin and at a space behind a character that isn't white space.

    The pre-tokenizer's pattern takes a space into a match with what precedes it
    only within white space, so that nothing crosses these places. Characters
    whose first bytes some white space has are left alone.
    """
    begin = np.zeros(len(data) + 1, bool)
    back = np.zeros(len(data) + 3, np.uint8)
    back[3:] = data
    one, two, three = back[2:-1], back[1:-2], back[:-3]  # the bytes before each
    ascii_ = (one > 0x20) & (one < 0x7F)
    wide = (one >= 0x80) & ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    wide &= ~(((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)))
    begin[:-1] = (data == 0x20) & (ascii_ | wide)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin[:-1])


class Encoders:
    """Both tokenizers of a Python worker; A's units seen so far are kept, told apart by their bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.codec = Codec(b_path)
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(a_path)
        self.tokenizer.encode_special_tokens = True
        self.a, self.b = (Pieces(p) for p in _tables(a_path, b_path))
        self.numbers = SpanNumbers(_KEEP_UNITS)
        self._forget()

    def _forget(self) -> None:
        self.numbers.clear()
        self.places, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_a(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all rows, and where each row's begin."""
        starts = byte_units(data, offsets)
        if self.numbers.full(len(starts)):
            self._forget()
        ends = np.append(starts[1:], len(data))
        number, new = self.numbers(data, starts, ends)
        if len(new):
            raw = data.tobytes()
            units = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            rows = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            sizes = np.array([len(r) for r in rows], np.int64)
            self.places = np.concatenate((self.places, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, np.fromiter((i for r in rows for i in r), np.int64)))
        sizes = self.sizes[number]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(begin[-1]) + np.repeat(self.places[number] - begin[:-1], sizes)]
        return ids, begin[np.searchsorted(starts, offsets)]

    def encode_b(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of all rows (without the leading space, which B adds), and where each row's begin."""
        ids, begin, equal = self.codec.encode(data, offsets)
        if equal.all():
            return ids.astype(np.int64), begin
        raw = data.tobytes()
        rows = [ids[begin[i] : begin[i + 1]].tolist() if equal[i] else self.codec.reference.encode(raw[offsets[i] : offsets[i + 1]].decode()) for i in range(len(equal))]
        return np.fromiter((i for r in rows for i in r), np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)


def end_events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, side (0: A, 1: B), start and ids of blocks of end events; a row without tokens has one block without ids.

    start is the byte offset, in a space and the text, where the block's first
    token begins; ids are little-endian unsigned 32-bit numbers, or 16-bit ones
    where every id of both fits.
    """
    narrow = all(len(t) <= 1 << 16 for t in _tables(a_path, b_path))
    kind = "<u2" if narrow else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: Encoders = kept(f"alignment {a_path} {b_path}", lambda: Encoders(a_path, b_path))
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(2)):
                full = np.diff(offsets) > 0
                spaced = np.insert(data, offsets[:-1][full], 0x20)
                places = offsets + np.concatenate(([0], np.cumsum(full)))
                sides = (both.encode_a(spaced, places), both.encode_b(data, offsets))
                fine = full & both.a.spell(spaced, places, *sides[0]) & both.b.spell(spaced, places, *sides[1])
                rows, side, start, blocks = [np.flatnonzero(~fine)], [np.zeros((~fine).sum(), np.int64)], [np.zeros((~fine).sum(), np.int64)], [b""] * int((~fine).sum())
                for s, ((ids, begin), pieces) in enumerate(zip(sides, (both.a, both.b), strict=True)):
                    ends = np.concatenate(([0], np.cumsum(pieces.sizes[ids])))
                    n = np.where(fine, -(-np.diff(begin) // BLOCK), 0)
                    row = np.repeat(np.arange(to - at), n)
                    first = begin[row] + BLOCK * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                    last = np.minimum(first + BLOCK, begin[row + 1])
                    raw = ids.astype(kind).tobytes()
                    width = np.dtype(kind).itemsize
                    rows.append(row)
                    side.append(np.full(len(row), s))
                    start.append(ends[first] - ends[begin[row]])
                    blocks += [raw[width * a : width * b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                row = pa.array(at + np.concatenate(rows))
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(side).astype(np.int8)), pa.array(np.concatenate(start)), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "side", "start", "ids"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return text_batches(numbered).mapInArrow(encode, "row long, doc_id long, side byte, start long, ids binary")


@dataclass
class _Open:
    """Sums of a document that isn't through yet."""

    row: int
    doc_id: int | None
    sums: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))  # n_a, n_b, n_groups, n_links
    digest: object = field(default_factory=hashlib.sha256)
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def groups(self, spelt: bytes) -> None:
        """More groups, each with its end mark; the mark of the last is held back."""
        if self.sums[2]:
            self.digest.update(b";")
        self.digest.update(spelt[:-1])


class Sweep:
    """The machine: takes blocks of end events in order and gives finished documents."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        self.sizes = (a_sizes, b_sizes)
        names = [*(f"{i}{mark}".encode() for i in range(len(a_sizes)) for mark in ",|"), *(f"{i}{mark}".encode() for i in range(len(b_sizes)) for mark in ",;")]
        self.names = np.array(names, object)
        self.open: _Open | None = None
        none = np.zeros(0, np.int64)
        self.rest = ((none, none), (none, none))  # ids and ends of A and of B behind the last common end
        self.done: list[_Open] = []

    def take(self, rows: np.ndarray, doc_ids: list, sides: np.ndarray, starts: np.ndarray, blocks: list[np.ndarray]) -> None:
        """The next blocks, sorted by row, start and side."""
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:] != rows[:-1]
        new[0] = self.open is None or rows[0] != self.open.row
        firsts = np.flatnonzero(new)
        documents = [_Open(int(rows[i]), doc_ids[i]) for i in firsts.tolist()]
        if self.open is not None:
            documents.insert(0, self.open)
        number = np.cumsum(new) - (self.open is None)
        sides_of = []
        for s in (0, 1):
            some = np.flatnonzero(sides == s)
            sizes = np.array([len(blocks[i]) for i in some], np.int64)
            ids = np.concatenate([self.rest[s][0], *(blocks[i] for i in some)]).astype(np.int64)
            own = ids[len(self.rest[s][0]) :]
            length = self.sizes[s][own]
            total = np.cumsum(length)
            before = np.concatenate(([0], total))[np.cumsum(sizes) - sizes]
            ends = np.repeat((number[some] << _OFFSET_BITS) + starts[some] - before, sizes) + total
            sides_of.append((ids, np.concatenate((self.rest[s][1], ends))))
        self._groups(sides_of, documents)
        self.done += documents[:-1]
        self.open = documents[-1]

    def _groups(self, sides: list[tuple[np.ndarray, np.ndarray]], documents: list[_Open]) -> None:
        (a_ids, a_ends), (b_ids, b_ends) = sides
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last = common[-1] if len(common) else -1
        ka, kb = np.searchsorted(a_ends, last, "right"), np.searchsorted(b_ends, last, "right")
        here = (1 << _OFFSET_BITS) - 1
        self.rest = ((a_ids[ka:], a_ends[ka:] & here), (b_ids[kb:], b_ends[kb:] & here))  # of the last document, the first one next time
        a_ids, a_ends, b_ids, b_ends = a_ids[:ka], a_ends[:ka], b_ids[:kb], b_ends[:kb]
        if not len(common):
            return
        links = np.union1d(a_ends, b_ends)
        pair = a_ids[np.searchsorted(a_ends, links)] * len(self.sizes[1]) + b_ids[np.searchsorted(b_ends, links)]
        n = len(documents)
        counts = np.stack([np.bincount(x >> _OFFSET_BITS, minlength=n) for x in (a_ends, b_ends, common, links)], 1)

        ga, gb = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_before, b_before = np.searchsorted(ga, np.arange(len(common) + 1)), np.searchsorted(gb, np.arange(len(common)))
        code = np.empty(ka + kb, np.int64)
        code[np.arange(ka) + b_before[ga]] = 2 * a_ids + (a_ends == common[ga])
        code[np.arange(kb) + a_before[gb + 1]] = 2 * (len(self.sizes[0]) + b_ids) + (b_ends == common[gb])
        spelt = self.names[code].tolist()
        cuts = np.concatenate(([0], np.cumsum(counts[:, 0] + counts[:, 1]))).tolist()

        most = len(self.sizes[0]) * len(self.sizes[1])
        key, times = np.unique((links >> _OFFSET_BITS) * most + pair, return_counts=True)
        at = np.searchsorted(key, np.arange(n + 1) * most).tolist()
        for k, document in enumerate(documents):
            if counts[k, 2]:
                document.groups(b"".join(spelt[cuts[k] : cuts[k + 1]]))
                document.sums += counts[k]
                document.pairs.append((key[at[k] : at[k + 1]] - k * most, times[at[k] : at[k + 1]]))

    def finished(self) -> Iterator[tuple]:
        """row, doc_id, n_a, n_b, n_groups, n_links, digest, pairs and times of the documents that are through."""
        for d in self.done:
            pairs, times = d.pairs[0] if d.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(d.pairs) > 1:
                pairs, index = np.unique(np.concatenate([p for p, _ in d.pairs]), return_inverse=True)
                times = np.bincount(index, np.concatenate([t for _, t in d.pairs])).astype(np.int64)
            yield d.row, d.doc_id, *d.sums.tolist(), d.digest.hexdigest() if d.sums[2] else "", pairs, times
        self.done = []

    def end(self) -> None:
        if self.open is not None:
            self.done.append(self.open)
            self.open = None


def swept(events: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs (A id times B's size plus B id) with their times in the document."""
    a_table, b_table = _tables(a_path, b_path)
    whole = "int" if len(a_table) * len(b_table) < 1 << 31 else "long"
    arrow = pa.int32() if whole == "int" else pa.int64()
    kind = "<u2" if max(len(a_table), len(b_table)) <= 1 << 16 else "<u4"
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept(f"sweep {a_path} {b_path}", lambda: Sweep(*(np.array([len(p) for p in t], np.int64) for t in _tables(a_path, b_path))))
        machine.__init__(*machine.sizes) if machine.open is not None else None  # a task that was stopped left it open

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(machine.finished())
            if rows:
                *plain, pairs, times = zip(*rows, strict=True)
                begin = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))).astype(np.int32))
                columns = [pa.array(c, pa.string() if k == 6 else pa.int64()) for k, c in enumerate(plain)]
                columns += [pa.ListArray.from_arrays(begin, pa.array(np.concatenate(v)).cast(t)) for v, t in ((pairs, arrow), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not len(batch):
                continue
            blocks = [np.frombuffer(b, kind) for b in batch.column(4).to_pylist()]
            rows, sides, starts, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(1).to_pylist()
            steps = np.cumsum([len(b) for b in blocks]) // STEP
            cuts = [0, *(np.flatnonzero(steps[1:] != steps[:-1]) + 1).tolist(), len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                machine.take(rows[a:b], ids[a:b], sides[a:b], starts[a:b], blocks[a:b])
                yield from out()
        machine.end()
        yield from out()

    dealt = events.repartition(tasks_for(events.sparkSession), "row").sortWithinPartitions("row", "start", "side")
    return dealt.mapInArrow(sweep, f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{whole}>, times array<int>")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, held (documents that hold it linked) and best (1 if no other pair of its A id is held by more), stored."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"pair div {b_size}"))
    most = counts.groupBy("a").agg(F.max("held").alias("most"))  # no more rows than A has ids
    return stored(counts.join(F.broadcast(most), "a").select("pair", "held", (F.col("held") == F.col("most")).cast("int").alias("best")), "pairs")


def frequent_from(counts: DataFrame) -> int | None:
    """The least number of documents from which on at most FREQUENT pairs are held; None if there is none."""
    if counts.count() <= FREQUENT:
        return 0
    size = Window.orderBy(F.desc("held")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.groupBy("held").agg(F.count("*").alias("pairs"))  # a row for each different number of documents
    return steps.select("held", F.sum("pairs").over(size).alias("so_far")).where(F.col("so_far") <= FREQUENT).agg(F.min("held")).first()[0]


def cross_tokenizer_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space,
    both without special tokens. Groups are cut where tokens of both end; links
    are the pairs of an A and a B token that overlap. n_best counts the links
    whose id pair is held by as many documents as any pair of their A id, and
    count_sum sums those numbers of documents over all links. groups_sha256 is
    over ``a1,a2|b1;a3|b2,b3``, ids in decimal.

    A null or empty text, and one that A's or B's tokens don't spell, has no
    tokens: zeros, and '' for the digest. Every row is a document of its own,
    rows that repeat each other too; a null doc_id stays null; long texts are
    taken whole; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    if a_path is None or b_path is None:
        a_file, b_file = default_files()
        a_path, b_path = a_path or a_file, b_path or b_file
    aligned = stored(swept(end_events(docs.select("doc_id", "text"), a_path, b_path), a_path, b_path), "aligned")
    counts = pair_counts(aligned, len(_tables(a_path, b_path)[1]))
    sums = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum")]

    least = frequent_from(counts)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    often = F.col("held") >= F.lit(least) if least is not None else F.lit(False)
    near = F.broadcast(counts.where(often))
    scored = links.join(near, "pair").groupBy("row").agg(*sums)
    others = counts.where(~often)
    if not others.isEmpty():
        rare = links.join(near.select("pair"), "pair", "left_anti").join(others, "pair").groupBy("row").agg(*sums)
        scored = scored.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    found = aligned.select("row", *whole, "groups_sha256").join(scored, "row", "left")
    return found.select(*whole, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
