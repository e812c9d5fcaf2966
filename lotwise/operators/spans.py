"""Where a text holds an excerpt, also an edited one: begin, end and likeness.

The span is the one with the fewest edits (a character changed, left out or put
in) against the whole excerpt; of equally good ones that which ends first, and
of these the shortest. Up to ``k`` edits leave one of ``k + 1`` parts of the
excerpt untouched, so that parts found as they are (the seeds) give all places
where such a span can be; a bit-parallel alignment runs over those windows only
and decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Likeness, in percent of the excerpt's characters that aren't edited, from which a span counts.
LEAST = 75.0
#: Words in a row that an excerpt and a text must share to be compared at all.
SEED_WORDS = 5


def lower(text: str) -> str:
    """In lower case, with each character still one character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def windows(excerpt: str, text: str, k: int) -> list[tuple[int, int]]:
    """Stretches of the text that hold every span of up to ``k`` edits, apart from one another."""
    n = len(excerpt)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    places: set[int] = set()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = text.find(excerpt[a:b])
        while at >= 0:
            places.add(at - a)
            at = text.find(excerpt[a:b], at + 1)
    out: list[tuple[int, int]] = []
    for at in sorted(places):
        start, stop = max(0, at - k), min(len(text), at + n + k)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def fewest_edits(excerpt: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(edits, stop) of the best alignment of the excerpt with a stretch of the text that ends at ``stop``, the first such end.

    ``anchored``: the stretch begins where the text does. A column of the edit
    table is held as two bit words of its steps up and down.
    """
    rows = (1 << len(excerpt)) - 1
    last = 1 << (len(excerpt) - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(excerpt):
        places[c] = places.get(c, 0) | 1 << i
    up, down, edits = rows, 0, len(excerpt)
    best = (edits, 0)
    for stop, c in enumerate(text, 1):
        met = places.get(c, 0) | down
        level = (((met & up) + up) ^ up) | met
        rise, fall = (down | ~(up | level)) & rows, up & level
        edits += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | anchored) & rows, (fall << 1) & rows
        up, down = (fall | ~(level | rise)) & rows, rise & level
        if edits < best[0]:
            best = (edits, stop)
    return best


def best_span(excerpt: str | None, text: str | None, least: float = LEAST) -> tuple[float, int, int] | None:
    """(likeness, start, stop) of the excerpt's best span in the text; None below ``least``. Case doesn't matter."""
    excerpt, text = lower((excerpt or "").strip()), lower(text or "")
    if not excerpt or not text:
        return None
    at = text.find(excerpt)
    if at >= 0:
        return 100.0, at, at + len(excerpt)
    most = int(len(excerpt) * (100 - least) / 100)
    found = None
    # the windows of k edits hold every span of up to k, so that one found there is the best
    k = min(1, most)
    while True:
        for a, b in windows(excerpt, text, k):
            edits, stop = fewest_edits(excerpt, text[a:b])
            if edits <= k and (found is None or edits < found[0]):
                found = (edits, a, a + stop)
        if found is not None or k == most:
            break
        k = min(2 * k + 1, most)
    if found is None:
        return None
    edits, a, stop = found
    back, size = fewest_edits(excerpt[::-1], text[a:stop][::-1], anchored=True)
    assert back == edits
    return 100 * (1 - edits / len(excerpt)), stop - size, stop


def snapped(text: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """A span grown to whole words, never across a tag, and pulled out of tags that it begins or ends in."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, stop + 1, F.length(text))
    start = start - F.length(F.regexp_extract(before, r"[^\s<>]*$", 0))
    stop = stop + F.length(F.regexp_extract(after, r"^[^\s<>]*", 0))
    head, tail = F.substring(text, F.lit(1), start), F.substring(text, start + 1, F.length(text))
    inside = head.rlike(r"<[A-Za-z/][^>]*$")
    into = F.when(inside, F.length(F.regexp_extract(tail, r"^[^>]*>(?:<[A-Za-z/][^>]*>)*", 0))).otherwise(F.length(F.regexp_extract(tail, r"^(?:<[A-Za-z/][^>]*>)+", 0)))
    upto = F.substring(text, F.lit(1), stop)
    cut = F.length(F.regexp_extract(upto, r"(?:<[A-Za-z/][^<>]*>)*(?:<[A-Za-z/][^<>]*)?$", 0))
    return start + into, stop - cut


def located(pairs: DataFrame, excerpt: str, text: str, least: float = LEAST) -> DataFrame:
    """``pairs`` with likeness, start and stop (places in the text, from 0) of the excerpt's best span, all null where there is none; and the span grown to whole words (mark_start, mark_stop)."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [best_span(e, t, least) or (None, None, None) for e, t in zip(batch[excerpt], batch[text], strict=True)]
            found = pd.DataFrame(spans, columns=["likeness", "start", "stop"], index=batch.index)
            yield batch.assign(likeness=found["likeness"].astype("float64"), start=found["start"].astype("Int32"), stop=found["stop"].astype("Int32"))

    out = pairs.mapInPandas(find, ", ".join([*kept, "likeness double", "start int", "stop int"]))
    start, stop = snapped(F.col(text), F.col("start"), F.col("stop"))
    return out.withColumns({"mark_start": start, "mark_stop": stop}).withColumns({c: F.when(F.col("mark_start") < F.col("mark_stop"), F.col(c)) for c in ("mark_stop", "mark_start")})


# Shares of description, price and borrower in a property's score.
WEIGHTS = {"coverage": 0.7, "price": 0.2, "borrower": 0.1}
#: Likeness below which a description counts as absent.
ABSENT = 50.0


def fidelity(texts: DataFrame, properties: DataFrame, key: str, text: str, description: str, price: str, borrower: str) -> DataFrame:
    """(key, properties, score): how faithfully each text gives what is known of its properties, 0 to 100 with one decimal.

    A property counts if it has a description: the likeness of its best span
    in the text, whether a number of the text is its price, and whether its
    borrower's name is there. The text's score is the mean; null without such
    properties.
    """
    known = properties.where(F.trim(F.coalesce(F.col(description), F.lit(""))) != "")
    spans = located(known.join(texts.select(key, text), key), description, text, ABSENT)
    numbers = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(\d[\d,]*)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    parts = {
        "coverage": F.coalesce("likeness", F.lit(0.0)),
        "price": F.when(F.array_contains(numbers, F.col(price).cast("decimal(38,0)").cast("string")), 100.0).otherwise(0.0),
        "borrower": F.when((F.col(borrower) != "") & F.contains(F.lower(F.col(text)), F.lower(F.col(borrower))), 100.0).otherwise(0.0),
    }
    scored = spans.select(key, sum((WEIGHTS[k] * parts[k] for k in ("price", "borrower")), WEIGHTS["coverage"] * parts["coverage"]).alias("_score"))
    means = scored.groupBy(key).agg(F.count("*").alias("properties"), F.round(F.avg("_score"), 1).alias("score"))
    return texts.select(key).join(means, key, "left").select(key, F.coalesce("properties", F.lit(0)).alias("properties"), "score")


def _seeds(rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = rows.select(key, tokens.alias("_w")).where(F.size("_w") >= words)
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - words + 1), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, words), " ")))
    return split.select(key, F.explode(F.array_distinct(grams)).alias("_seed"))


def seeded_pairs(excerpts: DataFrame, excerpt_key: str, excerpt: str, texts: DataFrame, text_key: str, text: str, words: int = SEED_WORDS) -> DataFrame:
    """(excerpt_key, text_key) of the excerpts and texts that share ``words`` words in a row.

    An excerpt of n words with e words edited shares some with the text that
    holds it if n >= (e + 1) * words + e. Seeds that are in excerpts are few, so
    that texts are reduced to these before pairs are formed.
    """
    asked = _seeds(excerpts, excerpt_key, excerpt, words)
    return _seeds(texts, text_key, text, words).join(asked, "_seed").select(excerpt_key, text_key).distinct()
