"""Connected components by contraction."""
import random


def test_components_of_paths_and_stars(spark):
    """Chains, stars, copies and loops, and no links at all; the links of later rounds shrink."""
    from functools import partial

    from lotwise.operators import linkage as L
    from lotwise.sources.scratch import stored

    draw = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)] + [(2000, 2000), (2001, 2002), (2002, 2001), (2001, 2002)] + [(draw.randrange(3000, 4000), draw.randrange(3000, 4000)) for _ in range(600)]
    want = {}
    for x in {x for p in links if p[0] != p[1] for x in p}:
        want[x] = x
    moved = True
    while moved:
        moved = False
        for x, y in links:
            low = min(want.get(x, x), want.get(y, y))
            for z in (x, y):
                if z in want and want[z] != low:
                    want[z], moved = low, True
    sizes = []

    def store(df):
        out = stored(df, "c")
        if df.columns == ["u", "v"]:
            sizes.append(out.count())
        return out

    assert {r["id"]: r["component"] for r in L.components(spark.createDataFrame(links, "a long, b long"), store).collect()} == want
    assert len(sizes) > 2 and sum(sizes) < 4 * sizes[0] and sizes[-1] == 0
    assert L.components(spark.createDataFrame([], "a long, b long"), partial(stored, name="c")).count() == 0
