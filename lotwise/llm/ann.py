"""Approximate nearest neighbours by multi-index hashing (operator 10).

Vectors get binary codes from several learned rotations (each is principal axes
turned by iterative quantisation, fitted to a bounded sample). A code is split
into substrings, each of which has an index of its own. A query probes every
index for the substrings within ``reach`` bits of its own, which by the
pigeonhole principle retrieves every code within ``tables * (reach + 1) - 1``
bits. That is the radius: what is within it is ranked by the original vectors in
double precision, and no more.

Tables and reach are chosen on the sample: the cheapest whose radius holds nearly
all of the sample's own neighbours. They are the same for all queries and blocks,
so the result doesn't depend on how rows are dealt. Rows are indexed in blocks,
each once, in the task that then streams the queries past it. A query that finds
fewer than ``k`` rows in all blocks is asked again with every substring probed,
which finds all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored, tasks_for

NEIGHBOURS = 20
#: Substrings of a code at most.
TABLES = 32
#: Bits of a substring: about the logarithm of a block's rows, between these.
SUBSTRING_BITS = (8, 13)
#: Vectors that the rotations and the probes are learned from, about (chosen by a hash of vec_id), and queries among these.
SAMPLE, SAMPLE_QUERIES = 10_000, 200
ROUNDS = 6
#: Share of the sample's neighbours that have to be within the radius.
FOUND = 0.975
#: What ranking a code costs, where meeting one in a bucket costs 1.
RANKED = 30.0
#: Rows of a block at most, and at least if there are tasks to spare.
BLOCK_MOST, BLOCK_LEAST = 1 << 16, 1 << 13


@dataclass
class Rotations:
    """Turns vectors into codes whose Hamming distance follows the inner product.

    Taking the mean from the rows alone changes no query's order. One more
    component brings every row to the same length (``reach``, the greatest),
    and queries have 0 there, so that a larger product is a smaller angle.
    A code is a row of substrings, each in 16 bits.
    """

    mean: np.ndarray
    axes: np.ndarray
    bits: int
    reach: float = 0.0

    def _substrings(self, projected: np.ndarray) -> np.ndarray:
        signs = (projected > 0).reshape(len(projected), projected.shape[1] // self.bits, self.bits)
        return (signs @ (1 << np.arange(self.bits))).astype(np.uint16)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return self._substrings(level(rows - self.mean, self.reach) @ self.axes)

    def query_codes(self, queries: np.ndarray) -> np.ndarray:
        return self._substrings(np.pad(queries, ((0, 0), (0, 1))) @ self.axes)


def level(centred: np.ndarray, reach: float) -> np.ndarray:
    """Rows with one more component that brings them to the length ``reach``."""
    return np.concatenate((centred, np.sqrt(np.maximum(reach**2 - (centred**2).sum(1, keepdims=True), 0))), 1)


def learn_rotations(sample: np.ndarray, mean: np.ndarray, reach: float, bits: int, tables: int = TABLES, rounds: int = ROUNDS) -> Rotations:
    """Iterative quantisation from several starting turns, side by side."""
    rows = level(sample - mean, reach)
    d = rows.shape[1]
    axes = np.linalg.eigh(rows.T @ rows)[1].T
    projected = rows @ axes.T
    random = np.random.default_rng(11)
    parts = []
    for _ in range(-(-bits * tables // d)):
        turn, _ = np.linalg.qr(random.standard_normal((d, d)))
        for _ in range(rounds):
            signs = np.where(projected @ turn > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ projected)
            turn = (u @ v).T
        parts.append(axes.T @ turn)
    return Rotations(mean, np.concatenate(parts, 1)[:, : bits * tables], bits, reach)


@lru_cache(maxsize=None)
def near_masks(most: int, bits: int) -> np.ndarray:
    """All substrings that differ from 0 in ``most`` bits at most."""
    return np.array([sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(bits), k)], np.int64)


@dataclass(frozen=True)
class Probes:
    """How many substrings are used, within how many bits each is probed, and the radius of the codes of these substrings."""

    tables: int
    reach: int
    radius: int


def learn_probes(rotations: Rotations, sample: np.ndarray, k: int = NEIGHBOURS, rows: int = BLOCK_LEAST) -> Probes:
    """The probes of least cost whose certain radius holds FOUND of the sample's neighbours.

    Probing ``tables`` substrings within ``reach`` bits retrieves every code
    within ``tables * (reach + 1) - 1`` bits, which is the radius, so that
    nothing within it depends on luck. The cost of a query is counted in buckets
    looked up, codes met in these, and codes within the radius that are ranked,
    in a block of ``rows``. With fewer than two vectors, or where no choice finds
    enough, everything is probed.
    """
    bits, most = rotations.bits, rotations.axes.shape[1] // rotations.bits
    everything = Probes(most, bits, most * bits)
    n = len(sample)
    if n < 2:
        return everything
    queries = np.arange(0, n, max(1, n // SAMPLE_QUERIES))
    score = sample[queries] @ sample.T
    score[np.arange(len(queries)), queries] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, n - 1)]
    asked, codes = rotations.query_codes(sample[queries]), rotations.codes(sample)
    apart = np.bitwise_count(asked[:, None, :] ^ codes[near]).cumsum(2, dtype=np.int64)
    others = np.bitwise_count(asked[:, None, :] ^ codes[None, :: max(1, n // 500), :]).cumsum(2, dtype=np.int64)
    best, cost = everything, math.inf
    for tables in range(1, most + 1):
        for reach in range(bits):
            radius = tables * (reach + 1) - 1
            if (apart[:, :, tables - 1] <= radius).mean() < FOUND:
                continue
            probes = tables * len(near_masks(reach, bits))
            now = probes + rows * (probes / (1 << bits) + RANKED * (others[:, :, tables - 1] <= radius).mean())
            if now < cost:
                best, cost = Probes(tables, reach, radius), now
            break
    return best


class MultiIndex:
    """An index for each of the first ``tables`` substrings of a block's codes."""

    def __init__(self, codes: np.ndarray, bits: int, tables: int) -> None:
        self.bits, self.tables, self.size = bits, tables, len(codes)
        words = codes[:, :tables]
        self.wide = self._wide(words)
        # one array of rows for all tables, and where each bucket of each table begins
        key = (np.arange(tables)[None, :] << bits) + words
        flat = key.T.ravel()
        self.order = np.argsort(flat, kind="stable") % max(1, self.size)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=tables << bits))))

    def _wide(self, words: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.pad(words, ((0, 0), (0, -words.shape[1] % 4)))).view(np.uint64)

    def within(self, code: np.ndarray, probes: Probes) -> np.ndarray:
        """The rows that probing finds within the radius, in order."""
        word = code[: self.tables].astype(np.int64)
        keys = ((word[:, None] ^ near_masks(probes.reach, self.bits)[None, :]) + (np.arange(self.tables)[:, None] << self.bits)).ravel()
        a = self.begin[keys]
        n = self.begin[keys + 1] - a
        some = np.flatnonzero(n)
        a, n = a[some], n[some]
        hit = np.zeros(self.size, bool)
        if len(n):
            ends = np.cumsum(n)
            hit[self.order[np.arange(ends[-1]) + np.repeat(a - ends + n, n)]] = True
        at = np.flatnonzero(hit)
        away = np.bitwise_count(self.wide[at] ^ self._wide(code[None, : self.tables])).sum(1, dtype=np.int64)
        return at[away <= probes.radius]


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Each row's product with the query, summed in the same order for every row, so that equal rows get equal numbers."""
    return (rows * query).sum(1)


def usable(vector: str, size: int | None = None) -> Column:
    """Not null, not zero, of finite components only (and of the given length)."""
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == size) if size is not None else ok, F.lit(False))


def search_blocks(coded: DataFrame, queries: DataFrame, rows: int, d: int, rotations: Rotations, probes: Probes, k: int) -> DataFrame:
    """query_id, vec_id, score, met: the k best of each block for each query, and how many rows its probes met there.

    ``coded`` and ``queries`` have vec_id, v and code. A block's rows come first
    and are indexed; queries stream past them, a batch at a time. Each row goes
    to one block, each query to every block.
    """
    tasks = tasks_for(coded.sparkSession)
    blocks = max(math.ceil(rows / BLOCK_MOST), min(tasks, math.ceil(rows / BLOCK_LEAST)), 1)
    own = coded.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v", "code")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v", "code")
    together = own.unionByName(asked).repartition(min(blocks, tasks), "block").sortWithinPartitions("block", "asks", "vec_id")
    tables = rotations.axes.shape[1] // rotations.bits

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, index = None, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            block, asks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            v = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(-1, d)
            codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(-1, tables)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if block[a] != of:
                    of, index, held = block[a], None, []
                if not asks[a]:
                    held.append((ids[a:b], v[a:b], codes[a:b]))
                    continue
                if index is None and held:
                    own_ids, own_v, own_codes = (np.concatenate(c) for c in zip(*held, strict=True))
                    held, index = [], MultiIndex(own_codes, rotations.bits, probes.tables)
                for i in range(a, b) if index is not None else ():
                    at = index.within(codes[i], probes)
                    at = at[own_ids[at] != ids[i]]
                    score = inner_products(own_v[at], v[i])
                    best = np.lexsort((own_ids[at], -score))[:k]
                    out.append((np.full(len(best), ids[i]), own_ids[at[best]], score[best], np.full(len(best), len(at))))
            query_id, vec_id, score, met = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score.astype(float)), pa.array(met, pa.int64())], names=["query_id", "vec_id", "score", "met"])

    return together.mapInArrow(search, "query_id long, vec_id long, score double, met long")


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k nearest other rows.

    ``vectors`` has vec_id and embedding. Nearest is the largest inner product;
    ties go to the smaller vec_id. Vectors that are null, zero or not finite
    throughout, rows without vec_id, and vectors of another length than most
    take no part. A row that repeats another's vec_id and vector counts once.
    An empty table gives no rows; other columns don't matter, and vectors may be of
    any length.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths[0]["d"], lengths[0]["n"]
    rows = rows.where(F.size("v") == d)
    share = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("rotation sample")), F.lit(1_000_000)) < share * 1_000_000).orderBy("vec_id").select("v").toPandas()["v"]
    drawn = np.stack(sample.to_list()) if len(sample) else np.zeros((1, d))
    mean = drawn.mean(0)
    square = F.aggregate(F.zip_with("v", F.array(*map(F.lit, mean.tolist())), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda total, x: total + x)
    bits = min(max(round(math.log2(min(n, BLOCK_LEAST))), SUBSTRING_BITS[0]), SUBSTRING_BITS[1])
    rotations = learn_rotations(drawn, mean, math.sqrt(rows.agg(F.max(square)).first()[0]), bits)
    probes = learn_probes(rotations, drawn, k, min(n, BLOCK_MOST))
    held = spark.sparkContext.broadcast(rotations)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(len(batch), d)
            asks = np.flatnonzero(batch.column(0).to_numpy() % every == 0)
            query_code: list[bytes | None] = [None] * len(batch)
            for i, code in zip(asks.tolist(), held.value.query_codes(v[asks]), strict=True):
                query_code[i] = code.tobytes()
            binary = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(v), binary(held.value.codes(v)), pa.array(query_code, pa.binary())], names=["vec_id", "v", "code", "query_code"])

    coded = stored(rows.mapInArrow(encode, "vec_id long, v binary, code binary, query_code binary").dropDuplicates(["vec_id", "v"]), "codes")
    queries = coded.where("query_code IS NOT NULL").select("vec_id", "v", F.col("query_code").alias("code"))
    found = stored(search_blocks(coded, queries, n, d, rotations, probes, k), "found")
    settled = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    few = stored(queries.join(settled, "vec_id", "left_anti"), "unsettled")
    if not few.isEmpty():
        most = rotations.axes.shape[1] // bits
        all_of = search_blocks(coded, few, n, d, rotations, Probes(1, bits, most * bits), k)
        found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(all_of)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
