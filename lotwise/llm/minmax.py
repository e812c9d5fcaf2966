"""Near duplicates by min-max hashing (operator 12).

Two documents link when their sets of three-word shingles have a Jaccard
similarity of 0.85 or more. The search goes by these steps:

1. *Min-max signatures.* Each of HASHES permutations of the shingle hashes is
   evaluated once and gives two signature values, the least and the greatest
   shingle under it. Either agrees between two sets with odds of their
   similarity, so that half the evaluations give a signature of the same
   length; as one shingle is rarely both, the two vary together less than
   values of two permutations, and the estimate is unbiased.
2. *Banding.* BAND values in a row (two permutations) are a bucket key, and
   documents meet where a key agrees. A pair at exactly 0.85 shares none of the
   40 keys with odds of 1.5e-13.
3. *Confirm.* Pairs whose signatures agree in too few values to be at 0.85
   (odds below 1e-12, :data:`AGREE`) go; the others are compared on their full
   sets. Where a bucket's members have to be compared with one another, parity
   bits of their shingles bound each pair's difference from below.

What keeps this linear: documents with the same set are one class and enter
once; within a bucket members are compared with its least document first; only
where a bucket's members are still in several components after that, their
parity bits are compared in blocks, those of the bucket's largest part not with
one another: first each with the nearest outside its component, then all that
the bound allows. Links inside a component need no comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_jaccard import bit_sketches, relabelled, verified
from .shared import discard, release, small, stored, tasks_for, text_batches
from .textkit import mix, per_row, shingle_sets, text_slices

#: Words in a shingle.
WIDTH = 3
#: Similarity from which documents link, as a fraction.
SIMILAR = (85, 100)
#: Permutations; each gives two values of a signature.
HASHES = 80
#: Values that make a bucket key.
BAND = 4
#: Documents of a bucket whose bits are compared in one go.
BLOCK = 512
#: Odds that a pair at SIMILAR is taken for too far apart by its signature.
MISS = 1e-12

_U = np.uint64
_FLIP = mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_TIMES = mix(_FLIP) | _U(1)


def _least_agreement() -> int:
    """The most values that may have to agree: fewer have odds below MISS at SIMILAR, by the binomial tail."""
    n, p = 2 * HASHES, SIMILAR[0] / SIMILAR[1]
    below, k = 0.0, 0
    while True:
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > MISS:
            return k
        k += 1


#: Signature values of which so many agree where sets are similar.
AGREE = _least_agreement()


def min_max(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The signature of each row of shingle hashes: least and greatest of each permutation in turn; rows without shingles have zeros."""
    out = np.zeros((len(begin) - 1, 2 * HASHES), _U)
    for k in range(HASHES):
        turned = (hashes ^ _FLIP[k]) * _TIMES[k]
        out[:, 2 * k] = per_row(np.minimum, turned, begin)
        out[:, 2 * k + 1] = per_row(np.maximum, turned, begin)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys of each row."""
    out = np.empty((len(signatures), 2 * HASHES // BAND), _U)
    for b in range(out.shape[1]):
        key = np.full(len(signatures), b + 1, _U)
        for v in range(b * BAND, (b + 1) * BAND):
            key = mix(key * _U(0x9E3779B97F4A7C15) + signatures[:, v])
        out[:, b] = key
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two words that identify the set, a byte of each signature value, and bucket keys, of each row."""
    schema = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, keys array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1)):
                hashes, begin = shingle_sets(data, offsets, WIDTH)
                values = min_max(hashes, begin)
                keys = band_keys(values)
                low = np.ascontiguousarray(mix(values).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(np.diff(begin).astype(np.int64)),
                        pa.array(per_row(np.bitwise_xor, hashes, begin).view(np.int64)),
                        pa.array(per_row(np.add, mix(hashes), begin).view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), to - at, [None, pa.py_buffer(low)]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "keys"],
                )

    return text_batches(docs.select("doc_id", "text")).mapInArrow(sign, schema)


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SIMILAR[1] * np.minimum(n, m) >= SIMILAR[0] * np.maximum(n, m)


def likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sizes and signatures allow a link."""
    ends = signed.select("doc_id", "n_shingles", "signature")
    fits = F.expr(f"{SIMILAR[1]} * least(n_a, n_b) >= {SIMILAR[0]} * greatest(n_a, n_b)")
    both = pairs.join(ends.toDF("a", "n_a", "s_a"), "a").join(ends.toDF("b", "n_b", "s_b"), "b").where(fits).select("a", "b", "s_a", "s_b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                same = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= AGREE))

    return both.mapInArrow(agree, "a long, b long").distinct()


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """key, doc_id, component and rest (not in the bucket's largest part) of the buckets whose members are in several components."""
    now = stored(buckets.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "members")
    parts = now.groupBy("key", "component").agg(F.count("*").alias("rows"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.max("rows").alias("largest")).where("parts > 1")
    return now.join(stored(main.drop("parts"), "open"), "key").withColumn("rest", F.col("component") != F.col("main")).drop("main")


def _halved(bits: np.ndarray) -> np.ndarray:
    """Parity bits at half their size."""
    middle = bits.shape[-1] // 2
    return bits[..., :middle] ^ bits[..., middle:]


class _Cell:
    """Documents to compare: part (two that cross, or one), id, component, size of the set and parity bits of each."""

    def __init__(self, part: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, bits: list[bytes]) -> None:
        self.part, self.ids, self.component, self.n = part, ids, component, n
        self.crossing = part.min() != part.max()
        self.size = np.array([len(b) for b in bits])
        self.rows = {s: np.flatnonzero(self.size == s) for s in np.unique(self.size).tolist()}
        self.bits = {s: np.frombuffer(b"".join(bits[i] for i in at.tolist()), np.uint64).reshape(len(at), -1) for s, at in self.rows.items()}
        self.half = {s: _halved(b) for s, b in self.bits.items()}
        self.place = np.zeros(len(ids), np.int64)
        for at in self.rows.values():
            self.place[at] = np.arange(len(at))

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that may link with document i, and in how many bits they differ. Sets that link are of one size of bits, or of the next."""
        s, found, apart = int(self.size[i]), [], []
        own = self.bits[s][self.place[i]]
        for other, bits, mine in ((s, self.bits, own), (2 * s, self.half, own), (s // 2, self.bits, _halved(own))):
            if other in bits:
                at = self.rows[other]
                ok = (self.component[at] != self.component[i]) & _sizes_fit(self.n[at], self.n[i])
                ok &= self.part[at] != self.part[i] if self.crossing else at != i
                some = np.flatnonzero(ok)
                if len(some):
                    differ = np.bitwise_count(bits[other][some] ^ mine).sum(1, dtype=np.int64)
                    # the symmetric difference is no smaller, and that of linked sets bounded by their sizes
                    passed = (SIMILAR[1] + SIMILAR[0]) * differ <= (SIMILAR[1] - SIMILAR[0]) * (self.n[at[some]] + self.n[i])
                    found.append(at[some][passed])
                    apart.append(differ[passed])
        return (np.concatenate(found), np.concatenate(apart)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def pairs(self, asking: np.ndarray, best: bool) -> np.ndarray:
        """Pairs of ids, the smaller first; with ``best`` each asking document's nearest only."""
        out = [np.zeros((2, 0), np.int64)]
        for i in asking.tolist():
            at, apart = self.near(i)
            if best and len(at):
                at = at[[apart.argmin()]]
            if len(at):
                out.append(np.stack((np.minimum(self.ids[at], self.ids[i]), np.maximum(self.ids[at], self.ids[i]))))
        return np.concatenate(out, 1)


def close_pairs(groups: DataFrame, sketches: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) that share a bucket, in different components, whose sizes and parity bits allow a link.

    A bucket's rest (what isn't in its largest part) is dealt into blocks, and so
    is that part; each block of the rest meets every block, while blocks of the
    largest part don't meet one another, so that n copies with m strangers among
    them cost n rows for each BLOCK strangers. With ``best`` each document of the
    rest names only its nearest partner in a block.
    """
    tasks = tasks_for(groups.sparkSession)
    spread = groups.withColumn("rest_blocks", F.expr(f"cast(ceil((rows - largest) / {BLOCK}) as int)")).withColumn("main_blocks", F.expr(f"cast(ceil(largest / {BLOCK}) as int)"))
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    spread = spread.withColumn("block", block)
    # a cell is (block of the rest, side, block): side 0 for a block of the rest at or after it, 1 for one of the largest part
    of_main = F.expr("transform(sequence(0, rest_blocks - 1), r -> struct(r as low, 1 as side, block as high))")
    of_rest = F.expr("concat(transform(sequence(0, rest_blocks - 1), r -> struct(least(r, block) as low, 0 as side, greatest(r, block) as high)), transform(sequence(0, main_blocks - 1), m -> struct(block as low, 1 as side, m as high)))")
    cells = spread.select("key", F.explode(F.when(F.col("rest"), of_rest).otherwise(of_main)).alias("cell"), "rest", "block", "doc_id", "component")
    placed = cells.select("key", "cell.low", "cell.side", "cell.high", F.when(F.col("side") == 1, F.col("rest").cast("int")).otherwise(F.col("block")).alias("part"), "doc_id", "component")
    order = ["key", "low", "side", "high"]
    together = placed.join(sketches, "doc_id").select(*order, "part", "doc_id", "component", "n", "bits").repartition(tasks, *order).sortWithinPartitions(*order, "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, len(order)):
            cell = _Cell(*(batch.column(i).to_numpy() for i in range(4, 8)), batch.column(8).to_pylist())
            side = batch.column(2)[0].as_py()
            if side == 1 and not cell.crossing:
                continue
            # of a block with the largest part the rest's documents ask; of two blocks of the rest either's, for all pairs one's
            asking = np.flatnonzero(cell.part == 1) if side == 1 else np.arange(len(cell.ids)) if best or not cell.crossing else np.flatnonzero(cell.part == cell.part[0])
            a, b = cell.pairs(asking, best)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return together.mapInArrow(compare, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of equal values of the first ``keys`` columns (whole numbers), of two rows or more, across batches."""
    held: list[pa.RecordBatch] = []
    last: list | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = [c[a] for c in columns]
            if key != last:
                if sum(map(len, held)) > 1:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, last = [], key
            held.append(batch.slice(a, b - a))
    if sum(map(len, held)) > 1:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable by links, and kept says that
    it is the document's own, so that one document of each component is kept. A
    null text, or one without words, has no shingles and links with nothing;
    one of fewer than three words has its whole sequence. Rows that repeat a
    doc_id are the same document; a row without doc_id gets null for both
    columns. Long texts are taken whole, an empty table gives no rows, and other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs), "signatures")
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "set_a", "set_b"]
    copies = stored(sets.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copies")
    classes = stored(signed.select("doc_id", *same).join(copies, same, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).alias("first")), "classes")
    later = classes.where("first < doc_id").select("doc_id").distinct()

    keys = sets.select("doc_id", "keys").join(small(stored(later, "later")), "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "shared-keys")
    buckets = stored(keys.join(shared, "key").select("key", "doc_id", "least").distinct(), "buckets")
    release(spark)
    met = small(stored(buckets.select("doc_id").distinct(), "met"))
    # rows that repeat a doc_id may hold several texts, each with a signature of its own
    own = stored(sets.join(met, "doc_id", "left_semi").select("doc_id", "n_shingles", "signature").distinct(), "met-signatures")
    discard(spark, signed)
    texts = stored(docs.join(met, "doc_id", "left_semi"), "texts")
    release(spark)

    first = buckets.where("least < doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = verified(stored(likely(first, own), "likely"), texts, WIDTH, SIMILAR)
    labels = relabelled(None, stored(links, "links"))
    bits = None
    for best in (True, False):
        groups = stored(_apart(buckets, labels), "groups")
        if groups.isEmpty():
            break
        if bits is None:
            bits = stored(bit_sketches(texts.join(groups.select("doc_id").distinct(), "doc_id", "left_semi").distinct(), WIDTH), "bits")
        more = verified(stored(close_pairs(groups, bits, best), "close"), texts, WIDTH, SIMILAR)
        labels = relabelled(labels, stored(more, "more-links"))
    mine = labels.withColumnsRenamed({"doc_id": "class", "component": "linked"})
    found = classes.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("class")).join(mine, "class", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("linked", "class").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id, d.doc_id <= coalesce(min(r.b), d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
