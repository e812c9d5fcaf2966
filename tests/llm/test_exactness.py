"""Bytes behind hashes, brute-force versions of trained operators, and files that aren't whole."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import ann, language_id, line_dedup, media, ngram_jaccard, packing, quality, queries, sentencepiece_codec, textkit, warc
from tests.compare import assert_same, views

from .helpers import components, odd_documents, odd_texts

SMALL = "/root/testdata/sf0.001"


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def collisions():
    """Texts of words and lines that collide under polynomial hashes modulo a power of two."""
    out = []
    for n in (1024, 2048):
        a, b = thue_morse(n)
        out += [a, b, f"{a} {b} {a}", f"{b} {a} {b}", "\n".join([" ".join([a] * 60)] * 2), " ".join([b] * 60)]
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_span_numbers_follow_bytes(monkeypatch, weak):
    if weak:  # every span collides with every other
        monkeypatch.setattr(textkit, "chunk_hashes", lambda chunks, begin, length, lane=0: np.zeros(len(length), np.uint64))
    words = ["a", "", "b", "a", "abcdefgh", "abcdefghi", "b", "abcdefgh", "abcdefg\0"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    numbers = textkit.SpanNumbers(100)
    for _ in range(2):
        got, _ = numbers(data, ends - [len(w) for w in words], ends)
        assert [(x == y) for x in got for y in got] == [(x == y) for x in words for y in words]


def test_colliding_words_have_their_own_ids(spark, collisions):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    got = packing.best_fit_packing(table(spark, collisions)).toPandas()
    for i, t in enumerate(collisions):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        own = got[got.doc_id == i].sort_values("piece")
        assert own["ids_crc32"].tolist() == [zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()) for k in range(0, len(ids), 4096)]


def test_colliding_words_dont_link_and_lines_stay(spark, collisions):
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.ngram_jaccard_join(table(spark, collisions)).collect()}
    assert got == components(list(enumerate(collisions)))
    kept = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(table(spark, collisions)).collect()}
    repeated = {4: collisions[4].split("\n")[0], 10: collisions[10].split("\n")[0]}
    assert kept == {i: repeated.get(i, t) for i, t in enumerate(collisions)}


def test_parity_of_colliding_words(spark, collisions):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in sentencepiece_codec.sentencepiece_codec(table(spark, collisions), ids=True).collect():
        assert r["ids"] == model.encode(collisions[r["doc_id"]]) and r["parity"] and r["round_trip"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], views(SMALL))


# language ID and quality, walked through row by row --------------------------


def test_language_of_each_text_by_brute_force(spark):
    docs = odd_documents(spark).where("length(text) < 3000 OR text IS NULL")
    model = language_id.train(docs)
    known = {int(h): i for i, h in enumerate(model.pieces.hashes)}

    def log_likelihood(word, lang):
        word, best = "▁" + word.lower(), [0.0]
        for end in range(1, len(word) + 1):
            terms = []
            for n in range(1, min(end, model.pieces.longest) + 1):
                piece = known.get(int(language_id.Pieces.of([word[end - n : end]]).hashes[0]), len(known) if n == 1 else None)
                if piece is not None:
                    terms.append(best[end - n] + math.log(model.p[piece, lang]))
            top = max(terms)
            best.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return best[-1]

    for r in language_id.with_language(docs, model, ["doc_id", "text", "score"]).collect():
        text = r["text"] or ""
        if not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        total = [math.log(model.prior[k]) + sum(log_likelihood(w, k) for w in text.split()) for k in range(len(model.languages))]
        odds = np.exp(np.array(total) - max(total))
        assert r["score"] == pytest.approx(max(odds) / sum(odds), rel=1e-3)
        if sorted(odds)[-2] < 0.99:
            assert r["lang_pred"] == model.languages[int(np.argmax(total))]


def test_long_words_are_cut_without_loss():
    pieces = language_id.Pieces.of(["▁", "a", "b", "ab", "▁a", "bab", "aabb"])
    p = np.random.default_rng(3).random((len(pieces.hashes) + 1, 2)) / 10
    word = "▁" + "".join(np.random.default_rng(4).choice(list("abx"), 400))
    parts = pieces.parts(word)
    assert "".join(parts) == word and len(parts) > 5
    assert np.allclose(language_id.word_log_likelihoods([word], pieces, p), language_id.word_log_likelihoods(parts, pieces, p).sum(0))


def test_expected_counts_are_the_gradient():
    pieces = language_id.Pieces.of(["▁", "a", "b", "ab", "bab"])
    p = np.random.default_rng(5).random((len(pieces.hashes) + 1, 1)) / 5
    for word in ("▁abab", "ab" * 40):
        got = language_id.expected_counts([word], np.array([2.0]), pieces, p[:, 0])
        base = language_id.word_log_likelihoods([word], pieces, p)[0, 0]
        for i in range(len(p)):
            more = p.copy()
            more[i] *= 1 + 1e-6
            assert got[i] == pytest.approx(2 * (language_id.word_log_likelihoods([word], pieces, more)[0, 0] - base) / 1e-6, abs=1e-3)


def test_quality_scores_by_walking_the_rules(spark):
    documents, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(documents, labels)
    assert model.rules
    rows = quality.with_statistics(documents, ["doc_id"]).collect()
    scored = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.with_quality(documents, model, ["doc_id"]).collect()}
    assert len(scored) == len(rows)
    for r in rows:
        total = model.intercept
        for rule, weight in model.rules:
            if all((r[name] <= at) == most for name, most, at in rule):
                total += weight
        score = 1 / (1 + math.exp(-total))
        assert scored[r["doc_id"]][0] == pytest.approx(score, abs=1e-8)
        assert abs(score - 0.7) < 1e-8 or scored[r["doc_id"]][1] == int(score >= 0.7)


def test_statistics_by_hand():
    text = "Ab1 ab1\nab1 | x!\n"
    for _, _, data, offsets in textkit.text_slices(pa.array([text, ""])):
        got = dict(zip(quality.STATS, quality._statistics(data, offsets)[0], strict=True))
    n = len(text)
    assert got["log_words"] == pytest.approx(math.log(6)) and got["log_bytes"] == pytest.approx(math.log(n + 1))
    assert (got["upper"], got["digits"], got["pipes"], got["marks"]) == pytest.approx((1 / n, 3 / n, 1 / n, 1 / n))
    assert got["distinct_words"] == pytest.approx(4 / 5) and got["one_byte_words"] == pytest.approx(1 / 5)
    assert got["lines_per_word"] == pytest.approx(3 / 5)


def test_clashing_names_in_stages(spark):
    docs = odd_documents(spark).withColumn("upper", docs_column()).withColumn("lang_pred", docs_column())
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    keep = ["doc_id", "text", "score", "upper", "lang_pred"]
    scored = quality.with_quality(docs, quality.train(docs, labels), keep)
    assert scored.columns == ["doc_id", "text", "upper", "lang_pred", "score", "predicted"] and scored.count() == docs.count()
    assert {r["upper"] for r in scored.collect()} == {"clash"}
    told = language_id.with_language(docs, language_id.train(docs), keep)
    assert told.columns == ["doc_id", "text", "upper", "lang_pred", "score"] and told.count() == docs.count()


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


# packing ---------------------------------------------------------------------


def least_bins(lengths, capacity):
    """The fewest bins, by trying every place for every piece."""
    best = len(lengths)

    def place(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(lengths):
            best = len(fill)
            return
        for k in range(len(fill)):
            if fill[k] + lengths[i] <= capacity:
                place(i + 1, [*fill[:k], fill[k] + lengths[i], *fill[k + 1 :]])
        place(i + 1, [*fill, lengths[i]])

    place(0, [])
    return best


def test_bounds_and_packings_hold_the_least_count_between_them():
    random = np.random.default_rng(9)
    for _ in range(60):
        lengths = random.integers(1, 4097, random.integers(1, 9))
        least = least_bins(sorted(lengths.tolist(), reverse=True), 4096)
        packed = len(packing.best_fit_decreasing(lengths)[2])
        assert packing.lower_bound(lengths) <= least <= packed <= math.ceil(11 / 9 * least + 6 / 9)


def test_packing_of_small_tables_is_least(spark):
    for sizes in ([2000, 2000, 2000, 90], [1300] * 6, [4000, 50, 40, 2000, 2100]):
        got = packing.best_fit_packing(table(spark, [" ".join(["word"] * (n - 1)) for n in sizes])).toPandas()
        assert sorted(got["length"]) == sorted(sizes)
        assert got["sequence_id"].nunique() == least_bins(sizes, 4096)
        assert set(got["table_gap"]) == {0}


def test_packing_reports_the_gap_of_the_whole_table(spark):
    random = np.random.default_rng(10)
    got = packing.best_fit_packing(table(spark, [" ".join(["word"] * int(n)) for n in random.integers(0, 3000, 500)]), part_pieces=60).toPandas()
    bins = got["sequence_id"].nunique()
    assert got["table_gap"].unique().tolist() == [bins - packing.lower_bound(got["length"].to_numpy())]
    assert bins <= len(packing.best_fit_decreasing(got["length"].to_numpy())[2]) + 1


# files -----------------------------------------------------------------------


def test_records_are_read_by_their_offsets():
    records = [warc.warc_record(i, f"http://x/{i}", b"<p>page %d</p>" % i * 50, "00" * 20, None) for i in range(40)]
    data, offsets = warc.archive_bytes(records)
    some = [h["warc-record-id"] for h, _ in warc.read_archive(data, offsets[5:9])]
    assert some == [f"<urn:page:{i}>" for i in range(5, 9)]
    assert list(warc.read_archive(data, offsets)) == list(warc.read_archive(data))
    big, at = warc.archive_bytes([warc.warc_record(1, "u", np.random.default_rng(1).bytes(300_000), "00" * 20, None)] * 3)
    assert len(list(warc.read_archive(big))) == 3 and len(list(warc.read_archive(big, at))) == 3
    with pytest.raises(ValueError):
        list(warc.read_archive(big[:-10]))


def test_the_first_track_with_samples_counts():
    one = media.write_media(np.random.default_rng(1).bytes(30 * media.FRAME))
    where = {p[-1]: (a, b) for p, a, b in media.boxes(one) if p[:1] == (b"moov",) or len(p) == 1}
    (ma, mb), (ta, tb) = where[b"moov"], where[b"trak"]
    track = one[ta - 8 : tb]
    # a track without table of keyframes before it: every sample of it is one
    stss = next((a, b) for p, a, b in media.boxes(one) if p[-1] == b"stss")
    renamed = one[: stss[0] - 4] + b"free" + one[stss[0] :]
    first = renamed[ta - 8 : tb]
    both = renamed[: ma - 8] + (mb - ma + 8 + len(track)).to_bytes(4, "big") + b"moov" + renamed[ma : ta - 8] + first + track + renamed[tb:]
    for name in (b"stco",):  # samples moved by the second track's size
        for p, a, _ in list(media.boxes(both)):
            if p[-1] == name:
                n = int.from_bytes(both[a + 4 : a + 8], "big")
                moved = (np.frombuffer(both, ">u4", n, a + 8) + len(track)).astype(">u4").tobytes()
                both = both[: a + 8] + moved + both[a + 8 + 4 * n :]
    assert len(media.media_tracks(both)) == 2
    found = media.read_media(both)
    assert found["keys"].tolist() == list(range(30))
    assert media.stored_payload(both, found) == media.stored_payload(one, media.read_media(one))


def test_broken_files_have_an_error_and_no_columns(spark):
    whole = media.write_media(bytes(media.FRAME))
    cut = [b"", b"\0", b"no media file at all", whole[:200], whole[:-100], *(whole[:k] for k in range(30, len(whole) - 600, 37))]
    rows = [(i, 1, x) for i, x in enumerate([whole, None, *cut])]
    got = sorted(media.media_columns(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect(), key=lambda r: r["doc_id"])
    assert got[0]["error"] is None and got[0]["payload_bytes"] == media.FRAME
    assert got[1]["error"] is None and got[1]["codec"] is None
    assert all(r["error"] and r["payload_bytes"] is None and r["keyframes"] is None for r in got[2:])


# nearest neighbours ----------------------------------------------------------


def test_queries_are_settled_by_probing(spark):
    """Several blocks, a cluster that holds a third of the rows, and equal vectors."""
    random = np.random.default_rng(12)
    v = random.standard_normal((20_000, 32))
    v[:6000] = 3 * random.standard_normal(32) + 0.4 * random.standard_normal((6000, 32))
    rows = v[random.permutation(len(v))]
    rows[100:130] = rows[99]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df).toPandas()
    hits = tied = 0
    for q, g in got.groupby("query_id"):
        score = (rows * rows[q]).sum(1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(len(rows)), -score))[:20]
        hits += len(set(order) & set(g["vec_id"]))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21))
        assert (score[g["vec_id"]] == g["score"]).all()
        same = g[g["score"].shift() == g["score"]]
        tied += len(same)
        assert (g["vec_id"].diff()[same.index] > 0).all()
    assert hits >= 0.9 * 20 * 1000 and tied > 0


@pytest.mark.parametrize(("rows", "size", "clustered"), [(6000, 48, False), (500, 64, False), (9000, 32, True)])
def test_learned_probes_retrieve_every_code_within_their_radius(rows, size, clustered):
    """What the query learns, not probes that a test chooses: the radius is the certain one, and holds nearly all neighbours."""
    random = np.random.default_rng(13)
    v = random.standard_normal((rows, size))
    if clustered:
        v = 0.4 * v + random.standard_normal((30, size))[random.integers(0, 30, rows)]
    mean, reach = v.mean(0), float(np.sqrt(((v - v.mean(0)) ** 2).sum(1).max()))
    rotations = ann.learn_rotations(v, mean, reach, 12)
    probes = ann.learn_probes(rotations, v)
    assert probes.radius == probes.tables * (probes.reach + 1) - 1 and probes.reach < 12
    codes = rotations.codes(v)
    index = ann.MultiIndex(codes, 12, probes.tables)
    asked = np.arange(0, rows, 20)
    found = 0
    for i, code in zip(asked.tolist(), rotations.query_codes(v[asked]), strict=True):
        apart = np.bitwise_count(codes[:, : probes.tables] ^ code[: probes.tables]).sum(1)
        at = index.within(code, probes)
        assert at.tolist() == np.flatnonzero(apart <= probes.radius).tolist()
        score = v @ v[i]
        score[i] = -np.inf
        found += int(np.isin(np.argsort(-score)[:20], at).sum())
    assert found >= 0.95 * 20 * len(asked)


def test_every_odd_text_has_the_same_language_twice(spark):
    docs = odd_documents(spark)
    model = language_id.train(docs)
    a, b = (sorted(map(str, language_id.with_language(docs, model, ["doc_id"]).collect())) for _ in range(2))
    assert a == b and len(a) == len(odd_texts()) + 3
