"""Language identification by segmentation-marginalised unigrams (operator 3).

Every language has a probability for each piece of a fixed public vocabulary.
The likelihood of a word is the sum over all ways to cut it into pieces of the
product of their probabilities, which a forward pass adds up; a text's is the
product over its words. The probabilities are fitted by expectation
maximisation (forward and backward passes, on Spark) to the word counts of a
bounded sample of training documents for each language.

Long words are cut only where no piece of the vocabulary crosses: there every
segmentation has a boundary, so the sum is the product of the parts' sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sentencepiece_codec import BYTE, CONTROL, PieceModel
from .sentencepiece_codec import UNKNOWN as UNKNOWN_PIECE
from .shared import stored, text_batches
from .textkit import SpanNumbers, find_sorted, keep_nothing, kept, mix, per_row, text_slices, word_spans

#: Longer runs without white space are searched for places that no piece crosses, and cut there.
WORD_CHARS = 24
#: Documents of each language that the model is fitted to, about (chosen by a hash of doc_id).
SAMPLE_DOCS = 500
ROUNDS = 3
#: Added to each piece's expected count.
SMOOTH = 0.05
UNKNOWN = "und"
#: Words whose lattices are in memory at once, and their characters in all.
LATTICE_WORDS, LATTICE_CHARS = 4000, 100_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_KEEP_WORDS = 1_500_000
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def vocabulary(path: str | None = None) -> list[str]:
    """The distinct pieces, lower-cased, of a public SentencePiece model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = PieceModel.parse(f.read())
    usual = (p.lower() for p, kind in zip(model.pieces, model.types, strict=True) if kind not in (UNKNOWN_PIECE, CONTROL, BYTE))
    return sorted({p for p in usual if p})


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix, 0 after a word's end; lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=0))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    grid = np.zeros((len(words), width), np.uint32)
    grid[np.arange(width) < sizes[:, None]] = flat
    return grid, sizes


@dataclass
class Pieces:
    """A vocabulary as sorted hashes; piece number len(hashes) stands for any other single character."""

    hashes: np.ndarray
    longest: int

    @classmethod
    def of(cls, words: list[str]) -> Pieces:
        grid, sizes = _codes(words)
        h = np.zeros(len(words), _U)
        for k in range(grid.shape[1]):
            h = np.where(sizes > k, h * _BASE + grid[:, k].astype(_U) + _U(1), h)
        return cls(np.unique(mix(h ^ (sizes.astype(_U) << _U(56)))), max(1, grid.shape[1]))

    def lattice(self, grid: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end 1..width: (length, words, piece numbers) of the pieces that end there."""
        out = []
        codes = grid.astype(_U) + _U(1)
        for end in range(1, grid.shape[1] + 1):
            h, scale, row = np.zeros(len(grid), _U), 1, []
            for n in range(1, min(end, self.longest) + 1):
                h = h + codes[:, end - n] * _U(scale)
                scale = scale * int(_BASE) % (1 << 64)
                found = find_sorted(self.hashes, mix(h ^ (_U(n) << _U(56))))
                if n == 1:
                    row.append((1, np.arange(len(grid)), np.where(found < 0, len(self.hashes), found)))
                else:
                    hit = np.flatnonzero(found >= 0)
                    if len(hit):
                        row.append((n, hit, found[hit]))
            out.append(row)
        return out

    def parts(self, word: str) -> list[str]:
        """The word cut wherever no piece of two or more characters crosses."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)
        crossed = np.zeros(len(codes) + 1, np.int64)
        h = codes.copy()
        for n in range(2, min(self.longest, len(codes)) + 1):
            h = h[:-1] * _BASE + codes[n - 1 :]
            at = np.flatnonzero(find_sorted(self.hashes, mix(h ^ (_U(n) << _U(56)))) >= 0)
            np.add.at(crossed, at + 1, 1)
            np.add.at(crossed, at + n, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(crossed[:-1]) == 0).tolist()), len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def as_words(text: str, pieces: Pieces) -> list[str]:
    """The lower-cased word with the vocabulary's mark of a word's begin, in parts if it is long."""
    word = "▁" + text.lower()
    return [word] if len(word) <= WORD_CHARS else pieces.parts(word)


def _groups(words: list[str]) -> Iterator[list[int]]:
    """Indices of words of like length, which share a matrix."""
    some: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if some and (len(some) >= LATTICE_WORDS or len(words[i]) * (len(some) + 1) > LATTICE_CHARS):
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def _forward(lattice: list[list[tuple[int, np.ndarray, np.ndarray]]], p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations of each prefix, and the logs that they are to be scaled by. p: pieces x languages."""
    alpha = np.zeros((len(lattice) + 1, n, p.shape[1]))
    alpha[0] = 1
    scale = np.zeros_like(alpha)
    for end, row in enumerate(lattice, 1):
        scale[end] = scale[end - 1]
        for k, hit, piece in row:
            part = alpha[end - k, hit] * p[piece]
            if end > WORD_CHARS:
                part *= np.exp(scale[end - k, hit] - scale[end, hit])
            alpha[end, hit] += part
        if end % WORD_CHARS == 0:  # keeps the numbers of long words within a float's range
            scale[end] += np.log(alpha[end])
            alpha[end] = 1
    return alpha, scale


def word_log_likelihoods(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log of the summed segmentations of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    for some in _groups(words):
        grid, sizes = _codes([words[i] for i in some])
        alpha, scale = _forward(pieces.lattice(grid), p, len(some))
        at = np.arange(len(some))
        out[some] = np.log(alpha[sizes, at]) + scale[sizes, at]
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words of one language, over all segmentations (one E step)."""
    expected = np.zeros(len(pieces.hashes) + 1)
    for some in _groups(words):
        grid, sizes = _codes([words[i] for i in some])
        weight, at = counts[some].astype(float), np.arange(len(some))
        lattice = pieces.lattice(grid)
        alpha, scale = (x[:, :, 0] for x in _forward(lattice, p[:, None], len(some)))
        beta, down = np.zeros_like(alpha), np.zeros_like(alpha)
        beta[sizes, at] = 1
        total = np.log(alpha[sizes, at]) + scale[sizes, at]
        for end in range(len(lattice), 0, -1):
            low = max(0, end - pieces.longest)
            down[low] = down[low + 1]
            for k, words_, piece in lattice[end - 1]:
                live = beta[end, words_] > 0
                hit, of = words_[live], piece[live]
                through = beta[end, hit] * p[of]
                expected += np.bincount(of, weight[hit] * alpha[end - k, hit] * through * np.exp(scale[end - k, hit] + down[end, hit] - total[hit]), len(expected))
                beta[end - k, hit] += through * np.exp(down[end, hit] - down[end - k, hit])
            if end % WORD_CHARS == 0:
                live = np.flatnonzero(beta[end - 1] > 0)
                by = beta[end - 1, live]
                beta[low:end, live] /= by
                down[low:end, live] += np.log(by)
    return expected


def fit_pieces(words: list[str], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over word counts, in this process."""
    p = np.full(len(pieces.hashes) + 1, 1 / (len(pieces.hashes) + 1))
    for _ in range(rounds):
        p = expected_counts(words, counts, pieces, p) + SMOOTH
        p /= p.sum()
    return p


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    pieces: Pieces
    p: np.ndarray


def bucket(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame, vocabulary_path: str | None = None) -> LanguageModel:
    """Fit to documents (doc_id, text, lang); rows without lang or text teach nothing.

    The sample is bounded by SAMPLE_DOCS a language, and shares of languages are
    counted over all rows. Word counts stay in a stored table that each round
    reads in parallel; the driver gets one number per piece and language.
    """
    spark = docs.sparkSession
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    shares = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    pieces = Pieces.of(vocabulary(vocabulary_path))
    size = len(pieces.hashes) + 1
    if not languages:
        return LanguageModel([], np.zeros(0), pieces, np.zeros((size, 0)))
    rate = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, SAMPLE_DOCS / shares[lang]))))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(lang: str, own: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, Counter())
                for word, n in Counter(text.split()).items():
                    for part in as_words(word, pieces):
                        own[part] += n
                if len(own) > 100_000:
                    yield flush(lang, held.pop(lang))
        for lang, own in held.items():
            yield flush(lang, own)

    counts = text_batches(sample.select("lang", "text")).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(counts, "language-words")
    p = np.full((size, len(languages)), 1 / size)
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                lang, word, n = (c.to_pylist() for c in batch.columns)
                for own in set(lang):
                    at = [i for i, x in enumerate(lang) if x == own]
                    got = expected_counts([word[i] for i in at], np.array([n[i] for i in at]), pieces, held.value[:, languages.index(own)])
                    sums[own] = sums[own] + got if own in sums else got
            for own, got in sums.items():
                some = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(some), pa.string()), pa.array(some), pa.array(got[some])], names=["lang", "piece", "n"])

        parts = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.array_sort(F.collect_list("n")).alias("n"))
        # summed in order of size, so that no order of tasks changes the last bits
        expected = parts.select("lang", "piece", F.aggregate("n", F.lit(0.0), lambda total, x: total + x).alias("n")).toPandas()
        p = np.full((size, len(languages)), SMOOTH)
        p[expected["piece"].to_numpy(), expected["lang"].map(languages.index).to_numpy(int)] += expected["n"].to_numpy()
        p /= p.sum(0)
        held.unpersist()
    prior = np.array([shares[x] for x in languages], float)
    return LanguageModel(languages, prior / prior.sum(), pieces, p)


class _Scorer:
    """Scores batches; keeps the likelihoods of words seen before by this Python worker, told apart by their bytes."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.numbers = SpanNumbers(_KEEP_WORDS)
        self.values = np.zeros((0, len(model.languages)), np.float32)

    def word_values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.numbers.full(len(starts)):
            self.numbers.clear()
            self.values = self.values[:0]
        number, new = self.numbers(data, starts, ends)
        if len(new):
            raw = data.tobytes()
            spans = [as_words(raw[a:b].decode(), self.model.pieces) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            flat = [w for s in spans for w in s]
            of = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            likelihood = word_log_likelihoods(list(of), self.model.pieces, self.model.p)
            begin = np.concatenate(([0], np.cumsum([len(s) for s in spans])))
            values = np.add.reduceat(likelihood[[of[w] for w in flat]], begin[:-1], axis=0)
            self.values = np.concatenate((self.values, values.astype(np.float32)))
        return self.values[number]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        model, n = self.model, len(offsets) - 1
        letters = per_row(np.logical_or, _ASCII_LETTER[data], offsets)
        for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
            letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
        if not model.languages:
            return [UNKNOWN] * n, np.zeros(n)
        starts, ends, first = word_spans(data, offsets)
        sums = np.zeros((n, len(model.languages)))
        if len(starts):
            values = self.word_values(data, starts, ends).astype(float)
            full = np.flatnonzero(np.diff(first))
            sums[full] = np.add.reduceat(values, first[full], axis=0)
        logit = np.log(model.prior) + sums
        logit -= logit.max(1, keepdims=True)
        odds = np.exp(logit)
        best = logit.argmax(1)
        score = np.where(letters, odds[np.arange(n), best] / odds.sum(1), 0)
        return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score


def _scorer_of(model: LanguageModel) -> _Scorer:
    """The scorer of this Python worker, kept over tasks as long as the model is the same."""
    scorer = kept("language scorer", lambda: _Scorer(model))
    if scorer.model is not model:
        keep_nothing()
        scorer = kept("language scorer", lambda: _Scorer(model))
    return scorer


def with_language(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred and score of each row.

    A null text, or one without a letter, is UNKNOWN with score 0, as is every
    text if there was nothing to learn from. score is the posterior of the
    predicted language; of equally likely ones the first by name is taken. A
    row's result follows from its text alone, so repeated rows get equal ones and
    very long texts are scored whole; an empty table gives no rows. Columns of ``docs`` that aren't in ``keep``
    don't matter; kept ones named lang_pred or score give way to the new ones.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    kinds = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "lang_pred string", "score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer_of(held.value)
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(at_text)):
                lang, value = scorer(data, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[: len(keep)]), pa.array(lang, pa.string()), pa.array(value)], names=[*keep, "lang_pred", "score"])

    at_text = keep.index("text") if "text" in keep else len(keep)
    return text_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(score, schema)


def language_id(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learned where crc32(doc_id as text) mod 5 is not 0.

    Repeated rows teach as often as they stand, and a row without doc_id is
    scored but neither held out nor learned from. For texts see
    :func:`with_language`. Other columns don't matter, whatever their names.
    """
    out = bucket("doc_id", 5) == 0
    model = train(docs.where(~out), vocabulary_path)
    return with_language(docs, model, ["doc_id"]).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
