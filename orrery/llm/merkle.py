"""Merkle manifest of a dataset: every row a leaf, a tree for each group of rows, and a tree over the groups' roots.

Leaves of a group are numbered by row_number over ranges of the key. A level is one grouping: nodes' numbers are divided by
the fanout, and the sorted digests of a node's children are hashed into it, while a group has more than one node. Siblings are
handed down from the roots: each level's nodes are joined with the entries that their parents made for them, so every join
is on unique keys, whatever a group's size. Below the first level of at most CUT nodes, levels are shuffled and written; the
levels above it are computed in one task, and what they hand down, at most CUT rows, is joined to the leaves at the end.

Digests are SHA-256; a node hashes the lowercase hex of its children. An entry of a path has the digests left and right of a
node in its run, as bytes; a run of one has none and is hashed again.

Cases: a null field is hashed as "-", any other one as its length in bytes, ":" and its text, so empty and null differ; null
keys come first, rows that repeat a key lie in the order of their leaves; a null group is a group of its own and the first
one; a lone leaf is its group's root, and a lone group's root is the root; an empty table gives no rows; texts are hashed
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common

CUT = 4096
_PATH = "array<struct<l: binary, r: binary>>"


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    """The leaf of a row's fields, in hex."""
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def _hash(raw: Column) -> Column:
    """SHA-256 of the hex text of raw digests, raw."""
    return F.unhex(F.sha2(F.lower(F.hex(raw)).cast("binary"), 256))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))


def group_key(column: Column) -> Column:
    """A text that is never null and sorts as the groups do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that follows from a leaf (hex) and its path."""
    part = lambda x: F.lower(F.hex(x))
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(part(s["l"]), a, part(s["r"])).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of the hex digests of a path, level by level, left to right."""
    raw = _joined(F.transform(path, lambda s: F.concat(s["l"], s["r"])))
    return F.sha2(F.lower(F.hex(raw)).cast("binary"), 256)


@dataclass
class Tree:
    """Levels of nodes (g, i, n: nodes of the group on this level, d: digest, c: children's digests), from the leaves up; on each
    level only groups that have more than one node below. ``cut``: the first level that one task holds."""

    levels: list[DataFrame]
    cut: int
    fanout: int

    def roots(self) -> DataFrame:
        """g, d of every group."""
        out = [level.where("n = 1").select("g", "d") for level in self.levels]
        found = out[0]
        for more in out[1:]:
            found = found.union(more)
        return found

    def _handed(self, level: DataFrame) -> DataFrame:
        """g, i, path for the children of a level's nodes (with path)."""
        kids = level.select("g", "i", "path", "c", F.posexplode("c").alias("at", "_"))
        left, right = F.slice("c", F.lit(1), F.col("at")), F.slice("c", F.col("at") + 2, F.lit(self.fanout))
        entry = F.array(F.struct(_joined(left).alias("l"), _joined(right).alias("r")))
        return kids.select("g", (F.col("i") * self.fanout + F.col("at")).alias("i"), F.concat(entry, "path").alias("path"))

    def _down(self, top: int, last: int, small: bool) -> DataFrame:
        """Nodes of level ``last`` with their paths up to level ``top``."""
        above = None
        none = F.array().cast(_PATH)
        for k in range(top, last - 1, -1):
            now = self.levels[k]
            if above is None:
                now = now.withColumn("path", none)
            else:
                above = above.hint("shuffle_hash") if small else above
                now = now.join(above, ["g", "i"], "left").withColumn("path", F.coalesce("path", none))
                if not small:
                    now = common.written(now, f"paths-{k}")
            if k > last:
                above = self._handed(now)
        return now

    def paths(self) -> DataFrame:
        """The leaves with path, from the leaf's own siblings up."""
        top = len(self.levels) - 1
        if not self.cut:
            return self._down(top, 0, True)
        upper = common.written(self._down(top, self.cut, True).select("g", F.col("i").alias("u"), F.col("path").alias("up")), "upper-paths")
        low = self._down(self.cut, 0, False)
        # at most CUT rows, each with two digests a level; groups that end below the cut have none
        low = low.withColumn("u", F.floor(F.col("i") / F.lit(self.fanout**self.cut))).join(F.broadcast(upper), ["g", "u"], "left")
        return low.withColumn("path", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("path", "up"))).drop("u", "up")


def build(leaves: DataFrame, fanout: int = 2) -> Tree:
    """The trees of leaves (g, i from 0 without gaps, n: leaves of the group, d: digest; others are kept), a written table."""
    if fanout < 2:
        raise ValueError("fanout has to be 2 or more")
    groups = leaves.where("i = 0").select("g", "n")
    most = groups.agg(F.max("n")).first()[0] or 0
    depth = 0
    while most > fanout**depth:
        depth += 1
    # nodes of each level, from the numbers of the groups alone: of groups that have more than one node below
    up = lambda k: F.ceil(F.col("n") / F.lit(fanout**k))
    counted = groups.agg(F.sum("n"), *(F.sum(F.when(up(k - 1) > 1, up(k)).otherwise(0)) for k in range(1, depth + 1))).first()
    sizes = [x or 0 for x in counted]
    cut = next((k for k, s in enumerate(sizes) if s <= CUT), depth)
    levels = [leaves.coalesce(1) if sizes[0] <= CUT else leaves]
    for k in range(1, depth + 1):
        below = levels[-1].where("n > 1").select("g", F.floor(F.col("i") / fanout).alias("i"), F.ceil(F.col("n") / fanout).alias("n"), F.struct("i", "d").alias("x"))
        # the children of a node: at most fanout rows
        nodes = below.groupBy("g", "i", "n").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]).alias("c"))
        now = common.written(nodes.select("g", "i", "n", _hash(_joined(F.col("c"))).alias("d"), "c"), f"nodes-{k}")
        levels.append(now.coalesce(1) if sizes[k] <= CUT else now)
    return Tree(levels, cut, fanout)


def _attached(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with what roots have for their g: broadcast if there are few groups, else by a join that spreads large groups."""
    return rows.join(F.broadcast(roots), "g") if roots.limit(CUT + 1).count() <= CUT else common.skew_join(rows, roots, "g")


def manifest(rows: DataFrame, fanout: int = 2) -> DataFrame:
    """rows (g, key, leaf in hex; others are kept) with subroot, root (hex) and path (from the leaf up to the root)."""
    rows = rows.withColumn("d", F.unhex("leaf"))
    leaves = common.written(common.placed(common.written(rows, "leaves"), "g", ["key", "d"], "i").withColumnRenamed("i_of", "n"), "numbered-leaves")
    trees = build(leaves, fanout)
    roots = common.written(trees.roots().select(F.lit("").alias("all"), F.col("g").alias("of"), "d"), "subroots")
    numbered = common.placed(roots, "all", ["of"], "i").select(F.col("all").alias("g"), "i", F.col("i_of").alias("n"), "d", "of")
    over = build(common.written(numbered, "numbered-subroots"), fanout)
    # one row: the root of the tree over all groups
    root = over.roots().select("g", F.lower(F.hex("d")).alias("root"))
    top = over.paths().join(F.broadcast(root), "g").select(F.col("of").alias("g"), F.lower(F.hex("d")).alias("subroot"), F.col("path").alias("over"), "root")
    found = _attached(trees.paths(), common.written(top, "roots"))
    return found.withColumn("path", F.concat("path", "over")).drop("over", "d", "i", "n")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_rows(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", key: str = "doc_id", **more: Column) -> DataFrame:
    """g, key, leaf of docs, and ``more`` columns."""
    return docs.select(group_key(F.col(group)).alias("g"), F.col(key).alias("key"), digest(*map(F.col, fields)).alias("leaf"), *(c.alias(n) for n, c in more.items()))


def verified(found: DataFrame, leaf: Column) -> DataFrame:
    """found (of ``manifest``) with folded_root, from another leaf (hex) for each row, and whether it is the root."""
    out = found.withColumn("folded_root", folded(leaf, F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    altered = [F.col("n_chars").cast("long") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when(common.crc32_of(F.col("doc_id")) % 7 == 0, digest(*altered))
    found = verified(manifest(leaf_rows(docs, tampered=tampered)), F.coalesce("tampered", "leaf"))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


_FIELD = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _levels_sql(name: str, source: str) -> str:
    """Nodes (k: level, g, i, n, d) over a table (g, i, n, d)."""
    return f"""{name} AS (SELECT 0 AS k, g, i, n, d FROM {source}
  UNION ALL SELECT k + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, g, i // 2, n)"""


def _steps_sql(nodes: str) -> str:
    """g, i (of the leaf), k, l, r: the siblings left and right on each level below the root."""
    return f"""SELECT a.g, a.i, b.k, coalesce(CASE WHEN (a.i >> b.k) % 2 = 1 THEN s.d END, '') AS l, coalesce(CASE WHEN (a.i >> b.k) % 2 = 0 THEN s.d END, '') AS r
  FROM (SELECT * FROM {nodes} WHERE k = 0) a JOIN {nodes} b ON b.g = a.g AND b.n > 1 AND b.i = a.i >> b.k LEFT JOIN {nodes} s ON s.g = b.g AND s.k = b.k AND s.i = xor(b.i, 1)"""


ORACLE = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256(concat({', '.join(map(_FIELD, FIELDS))})) AS d,
    sha256(concat({', '.join(_FIELD("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)})) AS other, {common.crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit FROM documents),
rows AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_levels_sql("nodes", "rows")},
subroots AS (SELECT g, d FROM nodes WHERE n = 1),
tops AS (SELECT 'all' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d FROM subroots),
{_levels_sql("above", "tops")},
root AS (SELECT d AS root FROM above WHERE n = 1),
low AS MATERIALIZED ({_steps_sql("nodes")}),
high AS MATERIALIZED ({_steps_sql("above")}),
steps AS (SELECT g, i, k, l, r FROM low UNION ALL SELECT x.g, x.i, 1000 + high.k, l, r FROM rows x JOIN tops ON tops.name = x.g JOIN high ON high.i = tops.i),
paths AS (SELECT g, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256, list({{'l': l, 'r': r}} ORDER BY k) AS path FROM steps GROUP BY g, i),
joined AS (SELECT x.*, s.d AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(path, []) AS path FROM rows x JOIN subroots s USING (g) CROSS JOIN root LEFT JOIN paths p ON p.g = x.g AND p.i = x.i),
fold AS (SELECT g, i, 0 AS step, CASE WHEN hit THEN other ELSE d END AS d, path FROM joined
  UNION ALL SELECT g, i, step + 1, sha256(path[step + 1].l || d || path[step + 1].r), path FROM fold WHERE step < len(path))
SELECT j.doc_id, j.d AS leaf, j.subroot, j.root, j.proof_sha256, f.d AS folded_root, f.d = j.root AS verified FROM joined j JOIN fold f ON f.g = j.g AND f.i = j.i AND f.step = len(f.path)
"""
