"""A group of near copies of which many are just too far from its first document: the comparison by blocks."""

import random

from pyspark.sql import functions as F

from orrery.llm import minhash


def test_members_left_apart_by_stars_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        words = list(base)
        for at in draw.sample(range(120), 0 if i == 0 else draw.choice([2, 5, 8, 9])):
            words[at] = f"x{draw.randrange(40)}"
        docs.append((i, " ".join(words)))
    docs += [(90, docs[7][1]), (91, None), (92, "one"), (93, "")]
    sets = {d: minhash.shingle_set(t, 2) for d, t in docs}
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]) and least[a] != least[b]:
                    low, changed = min(least[a], least[b]), True
                    least[a] = least[b] = low
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == {d: (len(sets[d]), least[d]) for d in sets}
    assert len(set(least.values())) > 5


def test_signatures_of_classes_outside_all_pairs_are_not_shuffled(spark):
    reps = spark.createDataFrame([(i, bytes([i])) for i in range(9)], "rep long, sig binary")
    asked = spark.range(10_000_000).where("id % 9999999 = 3").select(F.col("id").alias("rep"))
    found = minhash.signatures_of(reps, asked.union(asked))
    assert [tuple(r) for r in found.collect()] == [(3, bytearray([3]))]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
