import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, g string, leaf string, path string, root int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, fanout):
    """(top, siblings of each leaf as (left, right) lists, level by level) of a list of digests."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i - i % fanout : i - i % fanout + fanout]
            paths[leaf].append((run[: i % fanout], run[i % fanout + 1 :]))
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def plain(rows, fanout=2):
    """doc_id, leaf, subroot, root, proof, folded root of tampered rows, in any order."""
    groups = {}
    for r in rows:
        leaf = lambda n: digest("".join(map(field, (r[0], r[1], r[2], n, r[4]))))
        other = leaf(r[3] + 1) if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r[3])
        groups.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append((r[0] is not None, r[0] or 0, leaf(r[3]), r[0], other))
    done = [(sorted(groups[g]), *levels([x[2] for x in sorted(groups[g])], fanout)) for g in sorted(groups)]
    root, over = levels([sub for _, sub, _ in done], fanout)
    out = []
    for (leaves, sub, paths), above in zip(done, over):
        for x, path in zip(leaves, paths):
            fold = x[4]
            for left, right in path + above:
                fold = digest("".join(left) + fold + "".join(right))
            out.append((x[3], x[2], sub, root, digest("".join(d for s in path + above for side in s for d in side)), fold, fold == root))
    return out


def found(spark, rows, fanout=2):
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = [F.col("n_chars").cast("long") + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    hit = F.when(merkle.common.crc32_of(F.col("doc_id")) % 7 == 0, merkle.digest(*changed))
    out = merkle.verified(merkle.manifest(merkle.leaf_rows(docs, t=hit), fanout), F.coalesce("t", "leaf"))
    return out.select("key", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect()


def table(n):
    langs = ["fr", "de", None, "", "é", "fr", "fr"]
    rows = [(i * 3, f"s{i % 3}" if i % 5 else None, langs[i % 7], i if i % 4 else None, ["", "x", None, "é-\n" * i][i % 4], "G", "L", "P", 1) for i in range(n)]
    return rows + [(None, None, "fr", 1, "a", "", "", "", 0), (None, None, "fr", None, None, "", "", "", 0), rows[0], rows[0], (999, "s", "one", 4, "t" * 50_000, "", "", "", 2)] if n else rows


@pytest.mark.parametrize("n, fanout, cut", [(45, 2, 4096), (45, 2, 6), (61, 3, 5), (45, 2, 0)])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, fanout, cut):
    monkeypatch.setattr(merkle, "CUT", cut)
    rows = table(n)
    assert sorted(map(str, (tuple(r) for r in found(spark, rows, fanout)))) == sorted(map(str, plain(rows, fanout)))


def test_a_row_alone_is_its_own_root_and_no_rows_give_none(spark):
    (row,) = found(spark, [(1, None, None, None, None, "", "", "", 0)])
    assert row["root"] == row["subroot"] == row["leaf"] == digest("1:1----") and row["verified"]
    assert found(spark, []) == []


def test_any_changed_field_breaks_the_root(spark):
    rows = [(i, "s", "de", 1, "t", "", "", "", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = merkle.leaf_rows(docs, other=merkle.digest(*(F.lit("u") if c == "text" else F.col(c) for c in merkle.FIELDS)))
    out = merkle.manifest(leaves)
    assert merkle.verified(out, F.col("leaf")).where("verified").count() == 9
    assert merkle.verified(out, F.col("other")).where("verified").count() == 0


def test_fanout_below_two_raises(spark):
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame([("g", 0, 1, b"d")], "g string, i long, n long, d binary"), 1)
