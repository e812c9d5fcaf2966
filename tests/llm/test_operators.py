import hashlib
import io
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import ann, language_id, licenses, line_dedup, media, ngram_jaccard, packing, quality, sentencepiece_codec, textkit, warc

from .helpers import components, odd_documents, odd_texts, shingles, without_repeats


@pytest.fixture(scope="module")
def docs(spark):
    return odd_documents(spark).cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1 --------------------------------------------------------------------------


def test_shingle_sets_count_like_python_sets():
    texts = odd_texts()
    for at, to, data, offsets in textkit.text_slices(pa.array(texts), 1000):
        _, begin = textkit.shingle_sets(data, offsets)
        assert np.diff(begin).tolist() == [len(shingles(t)) for t in texts[at:to]]


def test_jaccard_components_equal_brute_force(docs):
    got = rows_of(ngram_jaccard.ngram_jaccard_join(docs))
    assert len(got) == docs.count()
    texts = dict(enumerate(odd_texts()))
    want = components(list(texts.items()))
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]])) for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_jaccard_chain_of_near_copies_and_frequent_shingles(spark):
    """A chain in which only neighbours link, among many texts that share one passage."""
    words = [f"c{i}" for i in range(400)]
    chain = [" ".join(words[12 * k : 12 * k + 120]) for k in range(15)]
    common = " ".join(f"z{i}" for i in range(14))
    shared = [f"{common} own{i} own{i}a own{i}b own{i}c" for i in range(150)]
    rows = list(enumerate([*chain, *shared, *shared[:3]]))
    got = {r["doc_id"]: r["component_id"] for r in rows_of(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == components(rows)


def test_jaccard_empty_table(spark):
    assert ngram_jaccard.ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_words_bound_the_odds_of_a_miss():
    assert ngram_jaccard.sketch_words(6) == 0
    sizes = [ngram_jaccard.sketch_words(b) for b in range(7, 16)]
    assert sizes == sorted(sizes) and sizes[-1] < (1 << 15) / 8


def test_partners_at_the_threshold_meet():
    """Of two sets as different as a link allows some keys are equal, whatever their sizes."""
    random = np.random.default_rng(2)
    none = ngram_jaccard.FrequentSet(np.zeros(0, np.uint64))

    def keys(a):
        return set(ngram_jaccard.sketch_keys(a, np.array([0, len(a)]), none)[0].tolist())

    for n in (*range(1, 40), 64, 65, 90, 127, 128, 129, 200, 300, 511, 700):
        for _ in range(12):
            a = np.sort(random.integers(0, 1 << 64, n, dtype=np.uint64))
            gone, new = (n // 7, n // 7) if random.random() < 0.5 else (n - -(-3 * n // 4), 0)
            b = np.sort(np.concatenate((random.permutation(a)[gone:], random.integers(0, 1 << 64, new, dtype=np.uint64))))
            assert not ngram_jaccard.similar(a, b) or keys(a) & keys(b)


def test_similar_is_exact_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert ngram_jaccard.similar(a, a[:75])
    assert not ngram_jaccard.similar(a, a[:74])
    assert not ngram_jaccard.similar(a[:0], a[:0])


# 2 --------------------------------------------------------------------------


def test_archive_round_trip_and_offsets():
    records = [warc.warc_record(i, f"http://x/{i}", b"<p>page %d</p>" % i * 50, "00" * 20, None) for i in range(40)]
    data, offsets = warc.archive_bytes(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert len(list(warc.read_archive(data))) == 40
    # a single record is readable from its offset with the dictionary alone
    head = data[: offsets[0]]
    (only,) = warc.read_archive(head + data[offsets[17] : offsets[18]])
    assert only[0]["warc-record-id"] == "<urn:page:17>"


def test_archived_pages(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "u1", big), (2, None, big), (3, "u 3\n", None), (4, "u4", ""), (5, "u5", "short"), (6, "u6", "short"), (7, "u7", big), (8, "u8", other), (8, "u8", other), (None, "n", other)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted(rows_of(warc.archived_pages(df)), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "revisit", 7), (2, "revisit", 7), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (8, "response", None), (None, "response", None)]
    for r in got[:9]:
        text = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
    assert warc.archived_pages(df.limit(0)).count() == 0


# 3 --------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces.of(["▁", "a", "b", "ab", "▁a", "▁ab"])
    vocabulary = {h: i for i, h in enumerate(pieces.hashes.tolist())}
    p = np.random.default_rng(1).random((len(vocabulary) + 1, 2)) / 10
    single = {s: language_id.Pieces.of([s]).hashes[0] for s in ["▁", "a", "b", "ab", "▁a", "▁ab"]}

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in single:
                out += p[vocabulary[int(single[word[:n]])], lang] * total(word[n:], lang)
            elif n == 1:
                out += p[len(vocabulary), lang] * total(word[1:], lang)
        return out

    words = ["▁ab", "▁abab", "▁", "▁axb", "ba"]
    got = language_id.word_log_likelihoods(words, pieces, p)
    assert np.allclose(got, [[math.log(total(w, k)) for k in (0, 1)] for w in words])


def test_expectation_maximisation_raises_the_likelihood():
    words, counts = ["▁the", "▁then", "▁thin", "▁hint"], np.array([50, 20, 10, 3])
    pieces = language_id.Pieces.of(["▁", "t", "h", "e", "n", "i", "th", "▁th", "▁the", "in"])
    value = [float(counts @ language_id.word_log_likelihoods(words, pieces, language_id.fit_pieces(words, counts, pieces, r)[:, None])[:, 0]) for r in (1, 3)]
    assert value[1] > value[0]


def test_language_id_odd_rows(docs):
    got = {r["doc_id"]: r for r in rows_of(language_id.language_id(docs))}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == language_id.UNKNOWN and got[0]["score"] == 0
    texts = odd_texts()
    for i, t in enumerate(texts):
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
        assert 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[None]["held_out"] is False


def test_language_id_learns_and_ignores_lang_of_what_it_predicts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = language_id.language_id(df).join(df, "doc_id")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    empty = language_id.language_id(df.where("lang IS NULL"))
    assert empty.count() == 0


# 4 --------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.quality_classifier(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.quality_classifier(docs, labels))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = rows_of(quality.quality_classifier(docs, labels.limit(0)))
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_classifier(docs.limit(0), labels).count() == 0


def test_rules_compile_to_columns(spark):
    rule = (("upper", True, 0.5), ("letters", False, 0.2))
    rows = spark.createDataFrame([(0.5, 0.3), (0.6, 0.3), (0.1, 0.2)], "upper double, letters double")
    assert [r[0] for r in rows.select(quality.rule_column(rule)).collect()] == [1.0, 0.0, 0.0]


# 5 --------------------------------------------------------------------------


def test_license_forms(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;")),
        (2, "LICENCED under the apache licence version 2 0"),
        (3, "text\nThis work is licensed under the GNU General Public License, version 3.\nmore\nReleased under the MIT Licence!"),
        (4, mit + " and more"),
        (5, None),
        (6, ""),
        (7, "license"),
    ]
    got = {r["doc_id"]: (r["license_id"], r["notice_lines"], r["notices"]) for r in rows_of(licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[1][0] == "MIT" and got[2] == ("Apache-2.0", 1, "Apache-2.0")
    assert got[3] == (None, 2, "GPL-3.0-only,MIT")
    assert got[4][0] is None and got[5] == got[6] == got[7] == (None, 0, "")


def test_license_odd_rows(docs):
    assert licenses.license_scan(docs).count() == docs.count()
    assert licenses.license_scan(docs.limit(0)).count() == 0


# 6 --------------------------------------------------------------------------


def test_bounds_never_exceed_a_packing():
    random = np.random.default_rng(3)
    for _ in range(40):
        lengths = random.integers(1, 4096, random.integers(1, 200))
        bins, offsets, fill = packing.best_fit_decreasing(lengths)
        assert fill.max() <= 4096 and packing.lower_bound(lengths) <= len(fill)
        assert np.bincount(bins, lengths).tolist() == fill.tolist()
    assert packing.lower_bound(np.array([2049, 2049, 2049])) == 3
    assert packing.lower_bound(np.array([1366] * 9)) >= 4


def test_packing_rounds_are_gapless_and_tight(spark):
    random = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(random.integers(0, 3000, 600))] + [(1000, "word " * 9000)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), part_pieces=150).toPandas()
    assert got["length"].sum() == sum(t.count("word") + 1 for _, t in rows)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 4096
    rest = got[got.length < 4096].length.to_numpy()
    assert got["sequence_id"].nunique() - (got.length == 4096).sum() <= len(packing.best_fit_decreasing(rest)[2]) + 1
    assert got[got.doc_id == 1000].sort_values("piece")["start"].tolist() == [0, 4096, 8192]


def test_packing_odd_rows(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.best_fit_packing(docs).toPandas()
    texts = odd_texts()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id == i].sort_values("piece")
        want = [(len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for p in (ids[k : k + 4096] for k in range(0, len(ids), 4096))]
        assert set(zip(own["length"], own["ids_crc32"], strict=True)) == set(want)
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


# 7 --------------------------------------------------------------------------


@pytest.mark.parametrize("least", [line_dedup.MIN_WORDS, 1, 3])
def test_line_dedup_equals_brute_force(docs, least):
    got = rows_of(line_dedup.line_dedup(docs, least))
    assert len(got) == docs.count()
    texts = {i: t for i, t in enumerate(odd_texts()) if t is not None}
    want = without_repeats(list(texts.items()), least)
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in texts} == want
    assert {r["text"] for r in got if r["doc_id"] == 0} == {None}
    assert {(r["score"], r["_doc"]) for r in got if r["doc_id"] == 1} == {("clash", 1)}


def test_line_dedup_runs_inside_a_document(spark):
    run = "\n".join(f"line {i} of the run with some more words" for i in range(9))
    rows = [(1, f"{run}\nmid\n{run}\n{run}"), (2, f"lead\n{run}"), (3, "\n".join(run.split("\n")[:4])), (4, "")]
    got = {r["doc_id"]: r["text"] for r in rows_of(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == without_repeats(rows, line_dedup.MIN_WORDS)
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 8 --------------------------------------------------------------------------


@pytest.mark.parametrize("frames", [1, 11, 12, 13, 24, 100])
def test_media_round_trip(frames):
    payload = np.random.default_rng(frames).bytes(frames * media.FRAME)
    data = media.write_media(payload)
    found = media.read_media(data)
    assert media.stored_payload(data, found) == payload
    assert (found["codec"], len(found["sizes"]), found["duration"] / found["timescale"]) == ("raw ", frames, frames / media.RATE)
    assert found["keys"].tolist() == list(range(0, frames, media.KEY_EVERY))
    kinds = [p[-1] for p, _, _ in media.boxes(data)]
    assert kinds[0] == b"ftyp" and kinds[-1] == b"mdat" and b"stsz" in kinds
    assert media.keyframe_at(found, 10**6) == found["keys"].max()


def test_media_boxes_refuse_to_leave_their_parent():
    with pytest.raises(ValueError):
        list(media.boxes(b"\0\0\1\0moov" + bytes(8)))


def test_document_media(docs):
    got = rows_of(media.document_media(docs))
    texts = odd_texts()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.document_media(docs.limit(0)).count() == 0


# 9 --------------------------------------------------------------------------


def test_sentencepiece_parity(docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows_of(sentencepiece_codec.sentencepiece_codec(docs, ids=True))
    texts = odd_texts()
    for r in got:
        if r["doc_id"] is not None:
            assert r["ids"] == model.encode(texts[r["doc_id"]] or "") and r["parity"] and r["round_trip"]
    assert sentencepiece_codec.sentencepiece_codec(docs.limit(0)).count() == 0


def test_sentencepiece_odd_spaces_and_marks():
    import public_tokenizers

    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert codec.by_units
    whole = sentencepiece_codec.build_tokenizer(codec.model)
    texts = [" a", "a  b   c", "\n\nx\n y ", "  ", "é x\x01y<s>", "a▁b ▁ x ▁▁ y", "tab\tx", "\r\nz", "😀"]
    for _, _, data, offsets in textkit.text_slices(pa.array(texts)):
        ids, begin, parity = codec.encode(data, offsets)
        assert parity.all()
        for i, t in enumerate(texts):
            want = codec.reference.encode(t)
            assert ids[begin[i] : begin[i + 1]].tolist() == want == whole.encode(t, add_special_tokens=False).ids
            assert whole.decode(want) == codec.reference.decode(want)


def test_unigram_model_is_rebuilt(tmp_path):
    """A unigram model protobuf, written here field by field."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1), ("▁a", -3.2, 1)]
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + varint(3 << 3) + varint(t)) for p, s, t in pieces)
    body += field(2, varint(3 << 3) + varint(1)) + field(3, field(1, b"identity"))
    path = tmp_path / "uni.model"
    path.write_bytes(body)
    codec = sentencepiece_codec.Codec(str(path))
    assert codec.model.kind == sentencepiece_codec.UNIGRAM and not codec.by_units
    for _, _, data, offsets in textkit.text_slices(pa.array(["ab ab", "  aab  b", "ba", ""])):
        assert codec.encode(data, offsets)[2].all()


# 10 -------------------------------------------------------------------------


def test_pigeonhole_gives_every_code_within_the_radius():
    random = np.random.default_rng(6)
    tables, bits = 16, 12
    codes = random.integers(0, 1 << bits, (30_000, tables)).astype(np.uint16)
    flips = random.permutation(tables * bits)
    for k in range(1, 40):
        codes[k] = codes[0]
        for f in flips[:k].tolist():
            codes[k, f // bits] ^= np.uint16(1 << f % bits)
    index = ann.MultiIndex(codes, bits, tables)
    full = np.bitwise_count(codes ^ codes[0]).sum(1)
    for reach in (0, 1, 2):
        radius = tables * (reach + 1) - 1
        assert index.within(codes[0], ann.Probes(tables, reach, radius)).tolist() == np.flatnonzero(full <= radius).tolist()


def exact(rows, k=20):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    return {q: sorted(((-float(v @ w), i) for i, w in usable if i != q))[:k] for q, v in usable if q % 20 == 0}


def test_nearest_neighbours(spark):
    random = np.random.default_rng(7)
    rows = [(i, random.standard_normal(64).tolist()) for i in range(3000)]
    rows[5], rows[6], rows[7], rows[40] = (5, None), (6, [0.0] * 64), (7, [float("nan")] * 64), (40, [None] + [1.0] * 63)
    rows[21] = (21, rows[20][1])
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    single = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = ann.nearest_neighbours(df).toPandas()
    want = exact(single)
    assert set(got.query_id) == set(want)
    hits = sum(len({i for _, i in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert got[(got.query_id == 20) & (got["rank"] == 1)].vec_id.tolist() == [21]
    score = {(q, i): -s for q, found in want.items() for s, i in found}
    assert all(abs(score[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got.itertuples() if (r.query_id, r.vec_id) in score)


def test_nearest_neighbours_of_vectors_of_many_lengths(spark):
    """The largest inner product isn't the smallest angle, and the mean isn't 0."""
    random = np.random.default_rng(8)
    v = (random.standard_normal((2500, 32)) + 0.7) * random.uniform(0.3, 2, (2500, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = ann.nearest_neighbours(df).toPandas(), exact(rows)
    hits = sum(len({i for _, i in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, 0.1]), (20, [3.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_archive_bytes_reads_like_a_file():
    data, _ = warc.archive_bytes([b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"])
    assert io.BytesIO(data).read() == data and len(list(warc.read_archive(data))) == 1
