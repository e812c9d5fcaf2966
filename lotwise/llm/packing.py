"""Best-fit packing with certified bin counts (operator 6).

Documents are tokenised; only those longer than a sequence are cut. Full pieces
are sequences of their own; the rest is packed by best-fit decreasing in many
partitions side by side. Dual feasible functions give each partition a lower
bound: where the bin count equals it, no packing of that partition has fewer.
Partitions give back the documents of their emptiest bins, the more the larger
their gap; these are exchanged into fewer partitions and packed again, until the
count of all bins equals the bound of the whole table (then no packing has
fewer), or one partition is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, text_batches
from .textkit import text_slices
from .tokens import tokenizer_file, word_tokenizer

CAPACITY = 4096
END_ID = 1
#: Pieces in a partition of the first round.
PART_PIECES = 20_000
#: Of each later round, so many partitions of the round before meet in one.
MEET = 4
#: Share of its bins that a partition gives back beyond its gap, least full first; full ones stay. Certified partitions do so too: partitions that are best each needn't be best together.
GIVE = 1 / MEET


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by dual feasible functions over the count of each length.

    With x = length / capacity: the identity; for each threshold t <= 1/2 the
    function that takes x > 1 - t as 1, x < t as 0 and others as they are; and
    for k = 1.. the rounding that takes x as floor((k + 1) x) / k unless
    (k + 1) x is whole.
    """
    return counted_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def counted_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same from the number of pieces of each length, 0 to capacity."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    weight, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    whole = number[capacity] - number[capacity - t]
    middle = weight[capacity - t] - weight[t - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and offset of each length, and how full each bin is. Equal lengths keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free_bits = 0  # bit f is set where a bin with free space f is open
    fill: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        roomy = free_bits >> n
        if roomy:
            f = n + (roomy & -roomy).bit_length() - 1
            b = open_with[f].pop()
            if not open_with[f]:
                free_bits &= ~(1 << f)
        else:
            b, f = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        f -= n
        if f:
            open_with[f].append(b)
            free_bits |= 1 << f
    return bins, offsets, np.array(fill, np.int64)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        for batch in batches:
            for at, _, data, offsets in text_slices(batch.column(1), 2 << 20):
                ids, begin = words.encode(data, offsets)
                docs_ = batch.column(0)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append(at + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([docs_.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_batches(docs.select("doc_id", "text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_round(items: DataFrame, parts: int, last: bool) -> DataFrame:
    """Pack each partition; rows of bins to exchange come back without bin."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths)
        bound = lower_bound(lengths)
        back = np.zeros(len(fill), bool)
        if not last:
            order = np.argsort(fill, kind="stable")
            gap = len(fill) - bound
            back[order[: gap + math.ceil(GIVE * len(fill))]] = True
            back &= fill < CAPACITY
        out = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["part"] = key[0]
        out["bin"] = bins
        out["at"] = offsets
        out["back"] = back[bins]
        out["gap"] = len(fill) - bound
        return out

    # by place in the stored table, not by value, so that repeated rows are dealt out too
    dealt = items.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(parts)), F.lit(parts)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, at long, back boolean, gap long"
    return dealt.groupBy("part").applyInPandas(pack, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, part_pieces: int = PART_PIECES) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bin_gap and table_gap.

    ``docs`` has doc_id and text; a null or empty text is its end token alone,
    and a text of any length is cut into pieces of CAPACITY tokens. Repeated
    rows are packed each; a null doc_id stays null. Pieces of equal length are
    placed in order of doc_id and piece. An empty table gives no rows. Other
    columns don't matter, whatever their names. bin_gap is what the bins of the piece's last partition exceed
    the lower bound by: 0 means certified best for that partition. table_gap is
    the same for all sequences: 0 means that no packing of the table has fewer.
    """
    pieces = stored(token_pieces(docs, tokenizer or tokenizer_file()), "pieces")
    full = pieces.where(F.col("length") == CAPACITY).select("*", F.lit(0).alias("round"), F.monotonically_increasing_id().alias("part"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("gap"))
    rest = pieces.where(F.col("length") < CAPACITY)
    count = np.zeros(CAPACITY + 1, np.int64)
    for row in rest.groupBy("length").count().collect():  # at most CAPACITY rows
        count[row["length"]] = row["count"]
    bound = counted_bound(count)
    parts = max(1, math.ceil(int(count.sum()) / part_pieces))
    placed, number, done = [full], 1, 0
    while True:
        packed = stored(_pack_round(rest, parts, last=parts == 1), "packed")
        bins = packed.groupBy("part").agg((F.max("bin") + 1).alias("all"), F.count_distinct(F.when(F.col("back"), F.col("bin"))).alias("back"))
        total = bins.agg(F.sum("all"), F.sum("back")).first()
        if parts == 1 or done + (total[0] or 0) == bound:
            placed.append(packed.select(*pieces.columns, F.lit(number).alias("round"), "part", "bin", "at", "gap"))
            break
        placed.append(packed.where("NOT back").select(*pieces.columns, F.lit(number).alias("round"), "part", "bin", "at", "gap"))
        done += total[0] - total[1]
        rest = packed.where("back").select(*pieces.columns)
        parts, number = max(1, math.ceil(parts / MEET)), number + 1
    table_gap = done + (total[0] or 0) - bound
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    # rounds, partitions and bins are packed into one number; a full piece's part is unique already
    sequence = F.when(F.col("round") == 0, -1 - F.col("part")).otherwise((F.col("round") * (1 << 26) + F.col("part")) * (1 << 26) + F.col("bin"))
    return every.select(*pieces.columns, sequence.alias("sequence_id"), F.col("at").alias("offset"), F.col("gap").alias("bin_gap"), F.lit(table_gap).cast("long").alias("table_gap"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
