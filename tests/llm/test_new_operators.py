"""Operators 11 to 13 against brute force on odd documents, and their parts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import alignment, divergence, minmax, ngram_jaccard, queries, textkit
from tests.compare import assert_same, views

from .helpers import odd_documents, odd_texts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return odd_documents(spark).cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", ["op7_line_dedup", "op12_minmax_near_dedup", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], views(SMALL))


# 11 -------------------------------------------------------------------------

SPECIAL = [
    "<|endoftext|> in <s>plain</s> text <unk>", "a▁b", "  two  spaces\n\n and\tlines \n x", "nbsp  after  em 　 wide", "it's we'll I'VE 12 345", "éè ü café naïve", "日本語の テスト です", "🎉🎉 emoji🎉 run",
    "x\x00y\x01z \x1c fs", "é combining", "tail space ", " lead", "\n", "\u0085 next\u0085 line", "don 't 's", "  ogham ᠎ old ​ zero", "𝒳𝒴 math", "ab" * 3000, "word " * 5000,
]


def aligned_by_hand(texts):
    """Each text's tokens, groups and links by encoding it whole and comparing every pair of ranges that can overlap."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_files()
    a_tokenizer, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_tokenizer.encode_special_tokens = True
    a_bytes, b_bytes = alignment.byte_level_pieces(a_path), alignment.sentencepiece_pieces(b_path)
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            out.append(([], [], "", []))
            continue
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((a, a_bytes), (b, b_bytes))]
        groups, links = [], []
        i = j = 0
        ga, gb = [a[0]], [b[0]]
        while True:
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x == y:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
            i, j = i + (x <= y), j + (y <= x)
            if i == len(a):
                break
            if x <= y:
                ga.append(a[i])
            if y <= x:
                gb.append(b[j])
        out.append((a, b, ";".join(groups), links))
    return out


def expected(texts):
    by_hand = aligned_by_hand(texts)
    held = Counter(p for *_, links in by_hand for p in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (len(a), len(b), groups.count(";") + bool(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for a, b, groups, links in by_hand
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def alignment_texts():
    return [*odd_texts(), *SPECIAL, SPECIAL[4], "one two"]


@pytest.mark.parametrize(("block", "step", "frequent"), [(alignment.BLOCK, alignment.STEP, alignment.FREQUENT), (7, 50, 40), (1, 1, 0)])
def test_alignment_equals_whole_texts(spark, monkeypatch, alignment_texts, block, step, frequent):
    """Also with blocks, steps and broadcasts so small that every document crosses them."""
    texts = alignment_texts if block > 1 else [t for t in alignment_texts if len(t or "") < 3000]
    for name, value in (("BLOCK", block), ("STEP", step), ("FREQUENT", frequent)):
        monkeypatch.setattr(alignment, name, value)
    table = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(texts)], "doc_id long, text string, pair string, ids array<int>")
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows_of(alignment.cross_tokenizer_alignment(table))}
    assert got == dict(enumerate(expected(texts)))


def test_alignment_of_odd_rows(docs, spark):
    got = rows_of(alignment.cross_tokenizer_alignment(docs))
    assert len(got) == docs.count()
    want = expected([r["text"] for r in docs.select("text").collect()])
    assert sorted(tuple(r[n] for n in NAMES) for r in got) == sorted(want)
    assert sum(r["doc_id"] is None for r in got) == 1
    assert alignment.cross_tokenizer_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_query_equals_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = dict(zip(texts, expected(list(texts.values())), strict=True))
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows_of(queries.QUERIES["op11_cross_tokenizer_alignment"](spark, SMALL))}
    assert got == want


def test_byte_units_never_change_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(alignment.default_files()[0])
    tokenizer.encode_special_tokens = True
    random.seed(3)
    letters = ["a", "B", "1", " ", " ", "\n", "\t", "'s", "!", " ", " ", "　", "\u0085", "é", "日", "🎉", "​", " ", "\x1c", "\x00"]
    for _ in range(400):
        text = " " + "".join(random.choice(letters) for _ in range(30))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = alignment.byte_units(data, np.array([0, len(data)])).tolist()
        units = [text.encode()[a:b].decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        assert [i for u in units for i in tokenizer.encode(u, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


# 12 -------------------------------------------------------------------------


def near_components(rows, width=3, top=85):
    import re

    def set_of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[i : i + width]) for i in range(len(words) - width + 1)])

    sets = {i: set_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= top * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_equal_brute_force(docs, spark):
    got = rows_of(minmax.near_duplicates(docs))
    assert len(got) == docs.count()
    want = near_components(list(enumerate(odd_texts())))
    assert {(r["doc_id"], (r["n_shingles"], r["component_id"]), r["kept"]) for r in got if r["doc_id"] is not None} == {(i, w, i == w[1]) for i, w in want.items()}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, None)]
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [minmax.BLOCK, 3])
def test_near_duplicates_in_chains_and_crowds(spark, monkeypatch, block):
    """Chains in which only neighbours link, crowds around one text, and texts just below the threshold."""
    monkeypatch.setattr(minmax, "BLOCK", block)
    random.seed(11)
    words = [f"c{i}" for i in range(600)]
    chain = [" ".join(words[8 * k : 8 * k + 150]) for k in range(40)]
    base = [f"b{i}" for i in range(120)]

    def edited(n):
        out = list(base)
        for i in random.sample(range(len(out)), n):
            out[i] = f"x{random.random()}"
        return " ".join(out)

    rows = list(enumerate([*chain, *(edited(n) for n in [0, 1, 1, 2, 2, 3, 3, 4, 5, 6] * 6)]))
    random.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == near_components(rows)


def test_min_max_values_estimate_similarity():
    random.seed(2)
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    errors = []
    for both in (500, 1000, 1700):
        a, b = np.sort(pool[: (2000 + both) // 2]), np.sort(pool[(2000 - both) // 2 : 2000])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        signed = minmax.min_max(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        errors.append((signed[0] == signed[1]).mean() - truth)
    assert max(map(abs, errors)) < 0.12
    assert minmax.AGREE == 100 or 90 < minmax.AGREE < 120


def test_both_ends_of_each_permutation_are_kept():
    hashes = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    signed = minmax.min_max(hashes, np.array([0, 49, 49]))
    for k in range(minmax.HASHES):
        turned = (hashes ^ minmax._FLIP[k]) * minmax._TIMES[k]
        assert signed[0, 2 * k] == turned.min() and signed[0, 2 * k + 1] == turned.max()
    assert not signed[1].any()


def test_shingle_width_is_a_parameter():
    for width in (1, 2, 3, 5):
        hashes, begin = textkit.shingle_sets(np.frombuffer(b"a b c a b cA b", np.uint8), np.array([0, 11, 14]), width)
        want = [{"a b c a b c".split()[i] if width == 1 else tuple("a b c a b c".split()[i : i + width]) for i in range(max(1, 6 - width + 1))}, {("a", "b")[i] if width == 1 else ("a", "b")[i : i + width] for i in range(max(1, 2 - width + 1))}]
        assert np.diff(begin).tolist() == [len(w) for w in want]
    assert ngram_jaccard.similar(np.arange(17, dtype=np.uint64), np.arange(20, dtype=np.uint64), (85, 100))
    assert not ngram_jaccard.similar(np.arange(17, dtype=np.uint64), np.arange(20, dtype=np.uint64), (86, 100))


# 13 -------------------------------------------------------------------------


def divergence_by_hand(rows, kept_from=30):
    """rows: (lang, source, text)."""
    import re

    rows = [(a or "", b or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        docs = Counter(w for _, _, ws in own for w in set(ws))
        terms = [w for w, n in docs.items() if n >= kept_from]
        v = len(terms)
        counts = {s: Counter() for _, s, _ in own}
        for _, s, ws in own:
            counts[s].update(w for w in ws if docs[w] >= kept_from)
        everything = sum(counts.values(), Counter())

        def prices(c):
            total = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * v) for w in terms}

        q, p = prices(everything), {s: prices(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(x, sum(abs(p[s][w] - p[x][w]) for w in terms)) for x in counts if x != s]
            above = [(w, p[s][w] - q[w]) for w in terms if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", above)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= 50]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_equals_brute_force(spark, monkeypatch):
    random.seed(4)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["École", "日本", "naïve"]
    rows = [(random.choice(["en", "de", None, ""]), random.choice(["a", "a", "a", "b", "c", None, "日"]), " ".join(random.choices(vocabulary, range(len(vocabulary), 0, -1), k=random.randrange(60)))) for _ in range(500)]
    rows += [("en", "textless", None), ("en", "textless", ""), ("solo", "x", "one Two 3 two"), ("en", "long", "taa TBA " * 20_000), ("fr", "b", "!!!"), ("fr", "c", None)]
    table = spark.createDataFrame([(*r, i, "clash", 1) for i, r in enumerate(rows)], "lang string, source string, text string, doc_id long, term string, n int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in rows_of(divergence.source_divergence(table)))
    assert got == divergence_by_hand(rows)
    assert any(r[2] == "term" and r[5] == 50 for r in got)


def test_divergence_of_odd_documents(docs, spark):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in rows_of(divergence.source_divergence(docs)))
    assert got == divergence_by_hand([(r["lang"], r["source"], r["text"]) for r in docs.collect()])
    assert divergence.source_divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_prices_of_large_counts(spark):
    n, total, kept = 3 * 10**14, 7 * 10**14, 10**6
    got = spark.range(1).select(divergence.price(*(divergence.F.lit(x) for x in (n, total, kept))).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_terms_end_with_rows():
    terms, row = divergence.text_terms(np.frombuffer("abCd é1x".encode(), np.uint8), np.array([0, 2, 4, 9]))
    assert terms.to_pylist() == ["ab", "cd", "é", "x"] and row.tolist() == [0, 1, 2, 2]
    assert isinstance(terms, pa.DictionaryArray)
