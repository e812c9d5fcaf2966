"""The fewest edits that find a span are tried first, with the result of trying the most at once."""

import random

from lotwise.operators import spans


def all_at_once(excerpt, text, least):
    k = int(len(excerpt) * (100 - least) / 100)
    found = None
    for a, b in spans.windows(excerpt, text, k):
        edits, stop = spans.fewest_edits(excerpt, text[a:b])
        if edits <= k and (found is None or edits < found[0]):
            found = (edits, a, a + stop)
    if found is None:
        return None
    edits, a, stop = found
    size = spans.fewest_edits(excerpt[::-1], text[a:stop][::-1], anchored=True)[1]
    return 100 * (1 - edits / len(excerpt)), stop - size, stop


def test_best_span_is_that_of_all_edits_at_once():
    draw = random.Random(11)
    for _ in range(4000):
        text = "".join(draw.choice("abcd ") for _ in range(draw.randint(1, 60))).strip() or "a"
        start = draw.randrange(len(text))
        excerpt = list(text[start : start + draw.randint(1, 14)])
        for _ in range(draw.randint(0, 4)):
            excerpt[draw.randrange(len(excerpt))] = draw.choice("abcdx")
        excerpt = "".join(excerpt).strip() or "b"
        least = draw.choice([10.0, 50.0, 75.0, 100.0])
        assert spans.best_span(excerpt, text, least) == all_at_once(excerpt, text, least)


def test_an_excerpt_with_one_edit_reads_little_of_its_text(monkeypatch):
    read = []
    real = spans.fewest_edits
    monkeypatch.setattr(spans, "fewest_edits", lambda e, t, anchored=False: read.append(len(t)) or real(e, t, anchored))
    text = "terms apply, " * 500 + "ECONOMY flat" + ", terms apply" * 500
    assert spans.best_span("EC¤NOMY", text, 50.0)[1:] == (6500, 6507) and sum(read) < 100
    read.clear()
    assert spans.best_span("economy", text, 50.0) == (100.0, 6500, 6507) and not read
