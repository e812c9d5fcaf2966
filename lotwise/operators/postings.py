"""An inverted index as stored tables: searches read postings and no text.

``postings`` has a row for each term, bucket of documents and batch of texts: the
documents that hold the term with the places where, sorted. A bucket is a range of
BUCKET document keys, so that a term that every document holds is many rows, and
the buckets in which all terms of a query occur are known before any places
are read. Documents (their places in the bucket), ends of their places and
places are stored as flat arrays, so that texts are dealt once and a search reads
only what it asks for. ``lengths`` has the words of each document, ``terms`` the
number of documents of each term.

Files hold ranges of terms, sorted, so that Parquet's own statistics skip all
but a query's. Every run adds a segment with the documents that aren't indexed
yet; a segment counts once its ``terms``, written last, are there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, stored

#: Document keys of a bucket.
BUCKET = 4096
#: Rows of a batch of texts.
_ROWS = 1000
K1, B = 1.2, 0.75

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_PACKED = "term string, bucket long, docs array<smallint>, ends array<int>, places array<int>"
_SCHEMAS = {"postings": f"{_PACKED}, segment int", "lengths": "doc long, words long, segment int", "terms": "term string, docs long, segment int"}


def tokens(text: str) -> list[str]:
    """The words that a query text means: runs of ASCII letters and digits in lower case."""
    return re.findall(r"[a-z0-9]+", text.lower())


def _fragments(texts: DataFrame) -> DataFrame:
    """term, bucket and postings of the rows (doc, text) of each batch, and each document's number of words as its place under the empty term."""

    def lists(ends: np.ndarray, items: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(items))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                doc = batch.column(0).to_numpy()
                data = batch.column(1).fill_null("").cast(pa.large_binary())
                _, offsets, raw = data.buffers()
                offsets = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
                raw = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                inside = _WORD[raw]
                edge = np.zeros(len(raw) + 1, bool)
                edge[offsets] = True
                first = inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1])
                packed = np.ascontiguousarray(raw[inside])
                ends = np.append(np.flatnonzero(first[inside]), len(packed)).astype(np.int64)
                words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(packed)).dictionary_encode()
                row = np.searchsorted(offsets, np.flatnonzero(first), "right") - 1
                begin = np.searchsorted(row, np.arange(len(doc) + 1))
                term, place = words.indices.to_numpy().astype(np.int64), np.arange(len(row)) - begin[row]
                bucket = doc // BUCKET
                order = np.lexsort((place, doc[row], bucket[row], term))
                term, place, row = term[order], place[order], row[order]
                new_doc = np.ones(len(row), bool)
                new_doc[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                posting = np.flatnonzero(new_doc)
                new_key = np.ones(len(posting), bool)
                new_key[1:] = (term[posting][1:] != term[posting][:-1]) | (bucket[row[posting]][1:] != bucket[row[posting]][:-1])
                key = np.flatnonzero(new_key)
                # places count from the first document of their row
                begun, stop = np.append(posting, len(row)), np.append(key, len(posting))
                ends = begun[1:] - np.repeat(posting[key], np.diff(stop))
                inner = (doc - bucket * BUCKET).astype(np.int16)
                columns = [lists(stop, inner[row[posting]]), lists(stop, ends.astype(np.int32)), lists(begun[stop], place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[posting[key]])).cast(pa.string()), pa.array(bucket[row[posting[key]]]), *columns], names=names)
                each = np.arange(len(doc) + 1)
                columns = [lists(each, inner), lists(each, np.ones(len(doc), np.int32)), lists(each, np.diff(begin).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([""] * len(doc)), pa.array(bucket), *columns], names=names)

    names = ["term", "bucket", "docs", "ends", "places"]
    return texts.mapInArrow(index, _PACKED)


class TextIndex:
    """The index that is stored at ``path`` (a folder that every executor can reach)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _segments(self) -> list[int]:
        """The segments that are written to the end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/terms")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath() for f in store.listStatus(root)] if store.exists(root) else []
        done = [p.getName() for p in names if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("segment=")) for n in done if n.startswith("segment="))

    def read(self, name: str) -> DataFrame:
        """The rows of ``postings``, ``lengths`` or ``terms`` of all whole segments; postings as held: (doc, places) of each document."""
        if name != "postings":
            return self.packed(name)
        begin = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
        held = F.transform("docs", lambda d, i: F.struct((F.col("bucket") * BUCKET + d).alias("doc"), F.slice("places", begin(i) + 1, F.get("ends", i) - begin(i)).alias("places")))
        return self.packed(name).select("term", "bucket", held.alias("held"), "segment")

    def packed(self, name: str) -> DataFrame:
        """The rows as they are stored."""
        paths = [f"{self.path}/{name}/segment={s}" for s in self._segments()]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def add(self, rows: DataFrame, key: str, text: str) -> int:
        """Index the rows whose key isn't indexed yet, as a new segment; gives its number.

        Keys are whole numbers; rows without one are left out, and of rows that
        repeat a key the one whose text sorts last is taken. A null text has no
        words but is a document.
        """
        segments = self._segments()
        number = segments[-1] + 1 if segments else 0
        new = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
        if segments:
            new = new.join(self.read("lengths").select("doc"), "doc", "left_anti")
        if not new.groupBy("doc").count().where("count > 1").isEmpty():
            new = new.groupBy("doc").agg(F.max("text").alias("text"))
        kept = self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_ROWS))
        try:
            found = stored(_fragments(new), "fragments")
        finally:
            self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
        lengths = found.where("term = ''").select((F.col("bucket") * BUCKET + F.col("docs")[0]).alias("doc"), F.col("places")[0].cast("long").alias("words"))
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/segment={number}")
        at = f"{self.path}/postings/segment={number}"
        found.where("term != ''").repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(at)
        written = self.spark.read.schema(_PACKED).parquet(at)
        counts = written.select("term", F.size("docs").cast("long").alias("n")).groupBy("term").agg(F.sum("n").alias("docs"))
        counts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms/segment={number}")
        return number

    def _of(self, name: str, words: list[str]) -> DataFrame:
        return self.packed(name).where(F.col("term").isin(words))

    @staticmethod
    def _docs(rows: DataFrame) -> DataFrame:
        return rows.select("bucket", F.explode("docs").alias("inner")).select((F.col("bucket") * BUCKET + F.col("inner")).alias("doc"))

    @staticmethod
    def _hits(rows: DataFrame) -> DataFrame:
        """term, doc and the number of places of each posting."""
        each = rows.select("term", "bucket", "ends", F.posexplode("docs").alias("i", "inner"))
        return each.select("term", (F.col("bucket") * BUCKET + F.col("inner")).alias("doc"), (F.get("ends", F.col("i")) - F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))).alias("tf"))

    def any_of(self, query: str) -> DataFrame:
        """doc of every document that holds a word of the query."""
        return self._docs(self._of("postings", tokens(query))).distinct()

    def all_of(self, query: str) -> DataFrame:
        """doc of every document that holds all words of the query, and those in double quotes side by side in that order.

        Buckets that lack a word are left out first; places are read of the words of
        phrases, and dealt for documents that hold all words.
        """
        parts = [tokens(p) for p in query.split('"')]
        phrases = [p for p in parts[1::2] if p]
        wanted = sorted({w for p in parts for w in p})
        if not wanted:
            return self.read("lengths").select("doc")
        found = self._of("postings", wanted)
        full = found.groupBy("bucket").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select("bucket")
        near = found.join(F.broadcast(full), "bucket", "left_semi")  # a row for each BUCKET documents
        # a term has one posting of a document
        hold = self._docs(near).groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("doc")
        if not phrases:
            return hold
        rows = self.read("postings").where(F.col("term").isin(sorted({w for p in phrases for w in p}))).join(F.broadcast(full), "bucket", "left_semi")
        rows = rows.select("term", F.inline("held")).join(hold, "doc", "left_semi")
        each = rows.groupBy("doc").agg(*(F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"_{i}") for i, w in enumerate(wanted)))
        return each.where(reduce(lambda a, b: a & b, (self._beside([F.col(f"_{wanted.index(w)}") for w in p]) for p in phrases))).select("doc")

    @staticmethod
    def _beside(places: list[Column]) -> Column:
        """Whether some place of the first is followed by one of each other, in order."""

        def shifted(column: Column, by: int) -> Column:
            return F.transform(column, lambda x: x - by)

        starts = [shifted(p, k) for k, p in enumerate(places)]
        return F.size(reduce(F.array_intersect, starts)) > 0

    def bm25(self, words: list[str]) -> DataFrame:
        """(doc, score) of the documents that hold one of the words; statistics are over all documents.

        Terms are added in the order of ``words``, so that equal documents have equal scores.
        """
        lengths = self.read("lengths")
        stats = lengths.agg(F.count("*").alias("N"), F.avg("words").alias("avg_len"))
        counted = self._of("terms", words).agg(*(F.coalesce(F.sum(F.when(F.col("term") == w, F.col("docs"))), F.lit(0)).alias(f"df{i}") for i, w in enumerate(words)))
        hits = self._hits(self._of("postings", words))
        each = hits.groupBy("doc").agg(*(F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(words)))
        joined = each.join(lengths, "doc").crossJoin(F.broadcast(stats.crossJoin(counted)))  # one row of statistics

        def term(i: int) -> Column:
            tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
            return F.ln(1 + (F.col("N") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("words") / F.col("avg_len")))

        return joined.select("doc", sum((term(i) for i in range(1, len(words))), term(0)).alias("score"))


#: The indexes of this process, by application, place and the table's files.
_indexes: dict[tuple, TextIndex] = {}


def index_of(spark: SparkSession, path: str, key: str, text: str) -> TextIndex:
    """The index of a table's text column in the shared folder; built at its first use in an application, and anew if the table's files are others."""
    rows = spark.read.parquet(path)
    found = (spark.sparkContext.applicationId, path, key, text, tuple(sorted(rows.inputFiles())))
    if found not in _indexes:
        index = TextIndex(spark, scratch_path(spark, "text-index"))
        index.add(rows, key, text)
        _indexes[found] = index
    return _indexes[found]
