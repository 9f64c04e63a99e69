import numpy as np
import pytest

from orrery.llm import decontaminate


def brute(text, items, n, slop):
    """(places hit, ids of items) of a text."""
    words, hit, ids = text.split(), set(), set()
    for item, want in items:
        want = want.split()
        for i in range(max(len(want) - n, 0) + 1):
            window = want[i : i + n]
            for shift in range(-len(want) - slop, len(words) + slop + 1):
                spots = [[p for p in range(shift + o - slop, shift + o + slop + 1) if 0 <= p < len(words) and words[p] == w] for o, w in enumerate(window)]
                if all(spots):
                    places = sum(spots, [])
                    hit |= set(range(min(places), max(places) + 1))
                    ids.add(str(item))
    return len(hit), sorted(ids)


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_equals_brute_force(spark, slop):
    draw = np.random.default_rng(11)
    items = [(i, " ".join(f"w{x}" for x in draw.integers(0, 60, 7))) for i in range(12)] + [(50, "a b c rare e")]
    docs = [(100, "x x b a rare c e x"), (101, "rare a b c e"), (102, "a b x c e rare"), (103, "a b c rare e"), (104, "e rare c b a")]
    for i in range(40):  # copies with some words moved
        want = items[i % 12][1].split()
        order = np.argsort(np.arange(7) + draw.uniform(-1, 1, 7) * (i % 4))
        docs.append((i, " ".join([f"w{x}" for x in draw.integers(0, 60, 5)] + [want[j] for j in order] + ["end"])))
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n=5, slop=slop)
    got = {r["doc_id"]: (r["n_hit"], list(r["item_ids"])) for r in found.collect()}
    assert got == {i: brute(t, items, 5, slop) for i, t in docs}
