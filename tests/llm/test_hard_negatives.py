import numpy as np
import pytest

from orrery.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, v string, row string, q int"


def table(draw, n, width, labels=4):
    return [(i, int(draw.integers(0, labels)), [float(x) for x in draw.normal(size=width).round(1)], "v", "r", 0) for i in range(n)]


def plain(rows, every=10):
    use = [(i, l, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, l, v, *_ in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, v in use:
        if i % every:
            continue
        scored = [(-int(v @ w), j, other == label) for j, other, w in use if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted((s, x) for s, x, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, r, x, -p, -s) for r, (s, x) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, every=10):
    df = spark.createDataFrame(rows, SCHEMA).where("label is not null")
    return sorted(tuple(r) for r in hn.mined(hn.vafile.integer_vectors(df, also=["label"]), hn.F.expr(f"vec_id % {every} = 0")).collect())


def test_equals_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 90)
    monkeypatch.setattr(hn, "QUERIES", 16)
    draw = np.random.default_rng(3)
    rows = table(draw, 400, 6)
    rows += [(500, None, [1.0] * 6, "", "", 1), (510, 1, None, "", "", 1), (520, 1, [1.0, None] * 3, "", "", 1), (530, 2, [float("nan")] * 6, "", "", 1), (540, 2, [], "", "", 1), (None, 2, [1.0] * 6, "", "", 1)]
    rows += [(600 + i, i % 2, [0.5] * 6, "", "", 1) for i in range(120)]  # equal vectors: ties
    rows += [(20, 3, rows[7][2], "", "", 1), (33, 0, rows[20][2], "", "", 1)]  # repeated ids
    rows += [(800 + i, i % 3, [float(i), 1.0], "", "", 1) for i in range(30)]  # another length
    rows += [(900, 9, [0.1] * 6, "", "", 1)]  # an anchor without positives
    assert found(spark, rows) == plain(rows) and len(plain(rows)) > 200


def test_empty_table_and_no_anchor(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0], "", "", 0), (2, 1, [1.0], "", "", 0)]) == []


def test_large_components_are_exact_or_raise(spark):
    rows = [(0, 0, [2.0**18, 1.0]), (1, 0, [2.0**18, 2.0]), (2, 1, [2.0**18 - 1, 3.0]), (3, 1, [2.0**18 - 1 / 256, 0.0])]
    rows = [(*r, "", "", 0) for r in rows]
    assert found(spark, rows) == plain(rows) and plain(rows)
    with pytest.raises(Exception, match="55 bits"):
        found(spark, [(0, 0, [2.0**30], "", "", 0), (1, 0, [2.0**30], "", "", 0)])


@pytest.mark.parametrize("same", [True, False])
def test_search_prunes_and_stays_exact(same):
    draw = np.random.default_rng(5)
    centres = draw.integers(-4000, 4000, (20, 8))
    v = np.repeat(centres, 100, axis=0) + draw.integers(-20, 20, (2000, 8))
    ids, labels = draw.permutation(2000), draw.integers(0, 3, 2000)
    tree = hn.BallTree.read(dict(zip((n for n, _ in hn.BallTree.FIELDS), hn.BallTree.of(ids, labels, v).row())), 8)
    exact = v[:50] @ v.T
    top = np.sort(exact, axis=1)[:, -30]
    block = hn.Queries(ids[:50], labels[:50], same, top * 8 // 10, top, v[:50], 5)
    hn.search(tree, block)
    for r in range(50):
        fits = sorted((-int(s), int(i)) for s, i, l in zip(exact[r], ids, labels) if i != ids[r] and (l == labels[r]) == same and top[r] * 8 // 10 <= s <= top[r])[:5]
        assert [(-int(s), int(i)) for s, i in zip(block.score[r], block.found[r]) if s > hn._NONE] == fits
    assert block.compared < 0.5 * 50 * 2000


def test_equal_rows_make_a_balanced_tree():
    tree = hn.BallTree.of(np.arange(1000), np.zeros(1000, int), np.ones((1000, 3), np.int64))
    leaves = tree.span[tree.right < 0]
    assert (leaves[:, 1] - leaves[:, 0]).max() <= hn.LEAF and tree.radius.max() == 0
