"""Small documents with every odd case, and brute-force answers."""

import random
import re

LONG = " ".join(f"long{i % 997}" for i in range(40_000))
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `key` string, `_doc` int, keys array<int>"


def odd_texts() -> list[str | None]:
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(120)]

    def edited(n: int) -> str:
        out = list(base)
        for i in random.sample(range(len(out)), n):
            out[i] = random.choice(words)
        return " ".join(out)

    near = [edited(n) for n in (0, 1, 2, 3, 4, 5, 8, 12, 20)]
    short = ["one", "one two", "one  two", "ONE two", "a b c d", "a b c d e", "A b c d e f", "a b c d e f g"]
    passage = " ".join(f"p{i}" for i in range(60))
    lines = [f"start {passage}\n{passage}\nend one two", f"other {passage}\n{passage}\n{passage}", "short line\nshort line\nshort line", "x\n" * 5]
    multi = "\n".join(f"row {i} " + " ".join(f"m{i}_{j}" for j in range(12)) for i in range(8))
    return [None, "", " \t\n ", *near, near[0], *short, *lines, multi, "before\n" + multi + "\nafter", LONG, LONG + " tail", "日本語 テスト", "1234 5678", "!!! ??? ..."]


def odd_documents(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t or ""), "clash", "k", i, [1]) for i, t in enumerate(odd_texts())]
    rows += [rows[3], rows[3], (None, "no id at all", "en", "s", 12, "c", "k", 1, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def without_repeats(docs: list[tuple[int, str]], least: int) -> dict[int, str]:
    """Line dedup by listing every run of lines with enough words."""
    seen, gone = {}, {d: set() for d, _ in docs}
    for d, text in docs:
        lines = text.split("\n")
        n_words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(n_words[i : j + 1]) >= least:
                    seen.setdefault(tuple(lines[i : j + 1]), []).append((d, i, j + 1))
    for places in seen.values():
        for d, i, j in places[1:]:
            gone[d].update(range(i, j))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}
