import random

import pytest

from orrery.llm import components, minhash


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {v: root(v) for v in list(up)}


def found(spark, edges):
    rows = components.components(spark.createDataFrame(edges, "a long, b long").repartition(8))
    return {r["v"]: r["component"] for r in rows.collect()}


N = 5000
DOWN = [0, *range(N, 0, -1)]
SHUFFLED = random.Random(1).sample(range(N), N)


@pytest.mark.parametrize("path", [DOWN, SHUFFLED])
def test_long_paths_with_and_without_forests(spark, monkeypatch, path):
    edges = list(zip(path, path[1:]))
    assert found(spark, edges) == dict.fromkeys(path, 0)
    rounds = []
    monkeypatch.setattr(components, "forest", lambda e: e.toDF("v", "r"))
    large = components._large_stars
    monkeypatch.setattr(components, "_large_stars", lambda e: rounds.append(1) or large(e))
    assert found(spark, edges) == dict.fromkeys(path, 0)
    assert len(rounds) <= 16


def test_random_edges_loops_nulls_and_none(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(600), draw.randrange(600)) for _ in range(350)]
    assert found(spark, [*edges, (None, 3), (4, None)]) == {v: c for v, c in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert found(spark, []) == {}


def test_chain_and_group_of_near_copies_equal_brute_force(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(60)]
    docs = [(1000 - i, " ".join(f"c{x}" for x in range(i * 6, i * 6 + 60))) for i in range(90)]
    for i in range(120):
        text = list(base)
        for _ in range(draw.randint(0, 7)):
            text[draw.randrange(60)] = draw.choice(words)
        docs.append((2000 + i, " ".join(text)))
    docs += [(5000, None), (5001, ""), (5002, "a"), (5003, "a"), (5004, " \t"), (5005, "A"), (6000, docs[0][1]), (6000, docs[150][1])]
    sets = [(i, minhash.shingle_set(t, 2)) for i, t in docs]
    links = [(i, i) for i, _ in docs]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            n = len(a & b)
            if n and 100 * n >= 80 * (len(a) + len(b) - n):
                links.append((i, j))
    want = union_find(links)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, kept int").repartition(5)
    rows = minhash.near_duplicates(frame, k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert len(rows) == len(docs) and all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in rows)


def test_no_rows_and_no_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    rows = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id int, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, False), (0, 0, False), (3, 3, True)]
