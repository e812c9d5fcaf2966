"""N-gram Jaccard join by parity sketches (operator 1).

Two documents link when their sets of five-word shingles have a Jaccard
similarity of 0.75 or more. The search goes by these steps:

1. *Parity sketch.* Every shingle hash is XORed into one of ``m`` words of its
   document's sketch, and into one bit of a longer bit sketch. A shingle in both
   documents cancels, so the number of differing words, and of differing bits,
   is at most the symmetric difference. Sizes within a size band bound that
   difference by ``D = 2U/7`` (``U``: the band's largest size).
2. *Pigeonhole join per size band.* ``m`` is chosen so that at least one
   non-empty word stays untouched by ``D`` changes (for sets of up to 64
   shingles with certainty: each shingle has a word to itself; above that the
   odds of a miss are below 1e-12 a pair, see :func:`sketch_words`). Documents
   meet where band, word number and word agree.
3. *Verify.* Candidates are compared on their full shingle sets.

What keeps this linear: documents with the same set are one class and enter
once; shingles that very many documents share stay out of the sketches of
documents that have enough others (leaving the same shingles out of both sides
never raises the symmetric difference); within a bucket members are compared
with its least document, and those of components that are still apart then by
their bit sketches, in blocks: first each with the nearest outside its
component, then all that the Hamming bound allows. Links inside a component
need no comparison, since they can't change it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, release, small, stored, tasks_for, text_batches
from .textkit import SHINGLE_WORDS, find_sorted, keep_nothing, mix, per_row, shingle_sets, text_slices

#: Similarity 0.75 as a fraction.
SIMILAR = (75, 100)
#: Sets up to this size have a sketch word for each shingle.
SINGLES = 64
#: Documents of a group that are compared by their bit sketches in one go.
BLOCK = 512
#: A shingle is frequent from this number of different sets on.
FREQUENT = 64
#: At most so many of the most frequent shingles stay out of sketches; a bound on speed's memory, without effect on results.
FREQUENT_MOST = 1 << 17
#: Members that one task compares with a representative.
FAN = 256

_U = np.uint64
_MISS = 1e-12


@lru_cache(maxsize=None)
def sketch_words(band: int) -> int:
    """Words in the sketches of a band of sets of up to 2**band shingles; 0: one for each shingle.

    Sets that link share c >= D shingles that are not frequent (at least half
    of a set isn't, and D bounds what one set has alone) and differ in D at
    most. Both estimates bound the odds that none of the c lies in a word
    without a change: all c in the D changed words, or each word changed or empty.
    """
    largest = 1 << band
    if largest <= SINGLES:
        return 0
    d = 2 * largest // 7
    m = max(16, d // 4)
    while min((min(d, m) / m) ** d, (1 - math.exp(-d / m) * (1 - math.exp(-d / m))) ** m) > _MISS:
        m += 1 + m // 64
    return m


def _bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each size, and that of the largest size it can link with."""
    own = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    up = np.ceil(np.log2(np.maximum(n * SIMILAR[1] // SIMILAR[0], 1))).astype(np.int64)
    low = SINGLES.bit_length() - 1
    return np.maximum(own, low), np.maximum(up, low)


def _band_keys(hashes: np.ndarray, begin: np.ndarray, band: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty sketch words of each row, and the row of each key. Hashes are sorted within rows."""
    sizes = np.diff(begin)
    row = np.repeat(np.arange(len(sizes)), sizes)
    words = np.array([sketch_words(b) for b in range(64 if not len(band) else int(band.max()) + 1)], _U)[band][row]
    single = words == 0
    word = ((hashes >> _U(32)) * words) >> _U(32)
    new = np.ones(len(hashes), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1]) | single[1:]
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.bitwise_xor.reduceat(hashes, at)
    where = (word[at] << _U(8)) + (band[row[at]].astype(_U) << _U(1)) + space[row[at]].astype(_U)
    return mix(value ^ mix(where + _U(0x51ED270B))).view(np.int64), row[at]


def _rows_of(values: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows (a mask), and where those rows begin."""
    sizes = np.diff(begin)
    return values[np.repeat(rows, sizes)], np.concatenate(([0], np.cumsum(sizes[rows])))


class FrequentSet:
    """Membership in a sorted array, with a bit table before the search."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(table & _U((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.bits[(hashes & _U((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = find_sorted(self.table, hashes[at]) >= 0
        return out


def sketch_keys(hashes: np.ndarray, begin: np.ndarray, frequent: FrequentSet) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of each row, sorted by row, and where each row's keys begin.

    Rows with at least half of their shingles not frequent use only those
    (space 0). The others use them too, so as to meet the former, and also all
    their shingles (space 1), so as to meet one another.
    """
    n = np.diff(begin)
    often = frequent(hashes)
    kept_at = np.concatenate(([0], np.cumsum(~often)))[begin]
    kept, kept_begin = hashes[~often], kept_at
    own, up = _bands(n)
    keys, rows = [], []
    everyone = np.ones(len(n), bool)
    mostly = 2 * np.diff(kept_begin) < n
    for space, values, start, chosen in ((0, kept, kept_begin, everyone), (1, hashes, begin, mostly)):
        for band, some in ((own, chosen), (up, chosen & (up != own))):
            ids = np.flatnonzero(some)
            if not len(ids):
                continue
            v, b = _rows_of(values, start, some)
            k, r = _band_keys(v, b, band[ids], np.full(len(ids), space))
            keys.append(k)
            rows.append(ids[r])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return key[order], np.searchsorted(row[order], np.arange(len(begin)))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many different sets of all documents hold, sorted.

    Each task counts over its own documents and passes on what it meets three
    times or more; sums of these are merged by Spark. Only the most frequent
    FREQUENT_MOST come to the driver (8 bytes each).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 3
            return pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["shingle", "sets"])

        keep_nothing()
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                hashes, begin = shingle_sets(data, offsets)
                signature = per_row(np.bitwise_xor, hashes, begin)
                first = np.zeros(len(begin) - 1, bool)
                first[np.unique(signature, return_index=True)[1]] = True
                held.append(_rows_of(hashes, begin, first)[0])
                size += len(held[-1])
                if size > 4_000_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    counts = text_batches(docs.select("text")).mapInArrow(count, "shingle long, sets long")
    top = counts.groupBy("shingle").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= FREQUENT).orderBy(F.desc("sets"), "shingle").limit(FREQUENT_MOST)
    return np.sort(top.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(_U))


def document_sketches(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, two words that identify the set, and bucket keys of each document."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = FrequentSet(held.value)
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1)):
                hashes, begin = shingle_sets(data, offsets)
                keys, starts = sketch_keys(hashes, begin, often)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(np.diff(begin).astype(np.int64)),
                        pa.array(per_row(np.bitwise_xor, hashes, begin).view(np.int64)),
                        pa.array(per_row(np.add, mix(hashes), begin).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(keys)),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    return text_batches(docs.select("doc_id", "text")).mapInArrow(sketch, schema)


def similar(one: np.ndarray, other: np.ndarray, least_similarity: tuple[int, int] = SIMILAR) -> bool:
    """Whether two sorted shingle sets link; an empty one never does."""
    top, bottom = least_similarity
    least, most = sorted((len(one), len(other)))
    if not least or bottom * least < top * most:
        return False
    both = int((find_sorted(one, other) >= 0).sum())
    return bottom * both >= top * (least + most - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE_WORDS, least_similarity: tuple[int, int] = SIMILAR) -> DataFrame:
    """Those pairs (a, b) whose sets of shingles of ``width`` words are similar enough.

    The members b of a representative a stream past its set; a representative
    with more than FAN members is dealt to several tasks.
    """
    tasks = tasks_for(pairs.sparkSession)
    body = texts.select(F.col("doc_id").alias("b"), "text")
    fans = pairs.groupBy("a").agg(F.count("*").alias("members")).withColumn("deals", F.ceil(F.col("members") / FAN).cast("int"))
    heads = fans.join(body.withColumnRenamed("b", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(None).cast("long").alias("b"), "text")
    dealt = pairs.join(fans.where("deals > 1").select("a", "deals"), "a", "left")
    members = dealt.join(body, "b").select("a", F.when(F.col("deals").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("deals"))).cast("int").alias("deal"), "b", "text")
    together = heads.unionByName(members).repartition(tasks, "a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        of = None
        for batch in batches:
            a_all, deal, b_all = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            is_head = np.asarray(b_all.is_null())
            b_all = b_all.fill_null(0).to_numpy()
            found_a, found_b = [], []
            for at, to, data, offsets in text_slices(batch.column(3)):
                hashes, begin = shingle_sets(data, offsets, width)
                for i in range(at, to):
                    own = hashes[begin[i - at] : begin[i - at + 1]]
                    if of != (a_all[i], deal[i]):
                        heads, of = [], (a_all[i], deal[i])
                    if is_head[i]:  # several, if rows repeat its doc_id
                        heads.append(own.copy())
                    elif any(similar(head, own, least_similarity) for head in heads):
                        found_a.append(a_all[i])
                        found_b.append(b_all[i])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return text_batches(together).mapInArrow(compare, "a long, b long")


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (doc_id, component) after more links; labels: those so far."""
    if labels is None:
        return stored(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    old = labels.withColumnsRenamed({"doc_id": "x", "component": "c"})
    ends = links.join(old, F.col("a") == F.col("x"), "left").select(F.coalesce("c", "a").alias("u"), "b")
    ends = ends.join(old, F.col("b") == F.col("x"), "left").select("u", F.coalesce("c", "b").alias("v"))
    merged = stored(connected_components(ends.where("u != v").distinct()), "merged").withColumnsRenamed({"doc_id": "x", "component": "c"})
    moved = labels.join(merged, F.col("component") == F.col("x"), "left").select("doc_id", F.coalesce("c", "component").alias("component"))
    return stored(moved.unionByName(merged.join(labels, F.col("x") == F.col("doc_id"), "left_anti").select(F.col("x").alias("doc_id"), F.col("c").alias("component"))), "labels")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links. A null text, or one
    without words, has no shingles and links with nothing. Rows that repeat a
    doc_id are the same document; a row without doc_id gets no component. Long
    texts are taken whole, an empty table gives no rows, and other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sketches = stored(document_sketches(docs, frequent_shingles(docs)), "sketches")
    sets = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "set_a", "set_b"]
    copies = stored(sets.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copies")
    classes = stored(sketches.select("doc_id", *same).join(copies, same, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).alias("first")), "classes")
    later = classes.where("first < doc_id").select("doc_id").distinct()

    keys = sets.select("doc_id", "keys").join(small(stored(later, "later")), "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "shared-keys")
    buckets = stored(keys.join(shared, "key").select("key", "doc_id", "least"), "buckets")
    discard(spark, sketches)  # most of the scratch space, and not read again
    release(spark)
    met = stored(buckets.select("doc_id").distinct(), "met")
    texts = stored(docs.join(small(met), "doc_id", "left_semi"), "texts")
    release(spark)

    first = buckets.where("least < doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = relabelled(None, stored(verified(first, texts), "links"))
    for best in (True, False):
        groups = _apart(buckets, labels)
        if groups.isEmpty():
            break
        labels = relabelled(labels, stored(verified(close_pairs(groups, texts, best), texts), "links"))
    mine = labels.withColumnsRenamed({"doc_id": "class", "component": "linked"})
    found = classes.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("class")).join(mine, "class", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("linked", "class").alias("component_id"))


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (least, doc_id, component): documents that met the same least document in buckets whose members are in several components."""
    now = stored(buckets.join(labels, "doc_id", "left").select("key", "least", "doc_id", F.coalesce("component", "doc_id").alias("component")), "members")
    open_ = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return stored(now.join(stored(open_, "open"), "key", "left_semi").select("least", "doc_id", "component").distinct(), "groups")


def bit_sketches(texts: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n and the bit sketch, of four bits or more for each shingle of the band's largest set, of each text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1)):
                hashes, begin = shingle_sets(data, offsets, width)
                n = np.diff(begin)
                bits = 4 << _bands(n)[0]
                row = np.repeat(np.arange(len(n)), n)
                start = np.concatenate(([0], np.cumsum(bits)))
                flips = np.bincount(start[row] + (hashes & (bits[row] - 1).astype(_U)).astype(np.int64), minlength=int(start[-1])) & 1
                packed = np.packbits(flips.astype(np.uint8), bitorder="little")
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int64)), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n.astype(np.int64)), raw.cast(pa.binary())], names=["doc_id", "n", "bits"])

    return text_batches(texts.select("doc_id", "text")).mapInArrow(sketch, "doc_id long, n long, bits binary")


def _folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch at a smaller size (a power of two bytes): halves are XORed, as a shingle's bit is its hash modulo the size."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def close_pairs(groups: DataFrame, texts: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of a group, in different components, whose bit sketches allow a link.

    The Hamming distance of two sketches is at most the symmetric difference,
    so pairs beyond (na + nb) / 7 can't link. Groups are compared in blocks of
    BLOCK documents. With ``best`` each document names only its nearest partner
    outside its component; without, all that pass.
    """
    top, bottom = SIMILAR
    tasks = tasks_for(groups.sparkSession)
    sketches = stored(bit_sketches(texts.join(groups.select("doc_id").distinct(), "doc_id", "left_semi")), "bits")
    sizes = stored(groups.groupBy("least").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    placed = groups.join(sizes, "least").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    cells = placed.select("least", "block", other, "doc_id", "component").select("least", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "doc_id", "component")
    together = cells.join(sketches, "doc_id").select("least", "low", "high", "block", "doc_id", "component", "n", "bits").repartition(tasks, "least", "low", "high").sortWithinPartitions("least", "low", "high", "doc_id")

    def pairs_of(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        block, ids, component, n = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:4])
        if len(np.unique(component)) < 2:
            return
        least = min(len(r[4]) for r in rows)
        bits = np.stack([_folded(r[4], least) for r in rows])
        mixed = block.min() != block.max()
        for i in range(len(rows) - (0 if best else 1)):
            others = slice(None) if best else slice(i + 1, None)
            ok = (component[others] != component[i]) & (bottom * np.minimum(n[others], n[i]) >= top * np.maximum(n[others], n[i]))
            if mixed:
                ok &= block[others] != block[i]
            at = np.flatnonzero(ok) + (0 if best else i + 1)
            if not len(at):
                continue
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
            passed = at[7 * differ <= n[at] + n[i]]
            if best and len(passed):
                passed = at[[differ.argmin()]]
            for j in passed.tolist():
                yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        of: tuple | None = None

        def found() -> pa.RecordBatch:
            pairs = list(pairs_of(held)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if key != of:
                    if len(held) > 1:
                        yield found()
                    held, of = [], key
                held.append(row)
        if len(held) > 1:
            yield found()

    return together.mapInArrow(compare, "a long, b long").distinct()


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
