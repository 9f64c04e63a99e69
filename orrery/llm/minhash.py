"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class at once; the representative is its smallest doc_id. Representatives with an
equal band of their signature are candidates. Their signatures are compared batch by batch; a pair is dropped once the
posterior probability (uniform prior) that its similarity reaches the threshold is below the miss probability. Survivors
are confirmed on the full sets.

A bucket is first compared with its smallest member only, so a bucket of m takes m - 1 comparisons and not m * m / 2.
What this leaves in different components is then compared in blocks of members: all of a bucket but its largest component
against all of it but the smallest member, each pair in the first bucket it shares. Signatures alone are dealt out for
that, pair by pair inside a task; texts follow only for the pairs that they leave. So no candidate pair is skipped unless
a chain of confirmed links joins it already. A hot bucket, hub or class is dealt over several tasks.

Two probabilities of a miss: a pair at the threshold 0.8 shares no band with (1 - 0.8 ** 6) ** 42 = 2.8e-6 (less above
it), and its signatures rule it out with 1e-9. Sets are counted, and classes of equal sets found, by 64-bit hashes of the
shingles and a 128-bit hash of a set; links between classes are confirmed on the shingles themselves.

Cases: null texts and texts without words have the empty set, are linked with nothing and form their own component; a text
of fewer words than a shingle is one shingle; rows that share a doc_id are one vertex; rows without doc_id are returned
with a null component, not kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common
from orrery.llm.components import components

HASHES, ROWS, BATCH = 256, 6, 32
BANDS = HASHES // ROWS
#: Posterior probability of a link below which a pair is dropped.
MISS = 1e-9
_MAX_WORDS = 1_000_000
#: Members of a bucket that a task holds at once in the comparison by blocks.
BLOCK = 256


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return ({tuple(words)} if words else set()) if len(words) < k else set(zip(*(words[i:] for i in range(k))))


class Hasher:
    """64-bit hashes of shingles, and signatures; words seen are kept in a bounded dictionary."""

    def __init__(self, k: int):
        self.k, self.seen = k, {}
        draw = np.random.default_rng(20_240_501)
        self.mul = draw.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.xor = draw.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles."""
        import xxhash

        words, seen = words_of(text), self.seen
        if not words:
            return np.zeros(0, np.uint64)
        if len(seen) > _MAX_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
        n = max(1, len(h) - self.k + 1)
        out = np.full(n, min(len(h), self.k), np.uint64)
        for i in range(min(self.k, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Low 16 bits of the HASHES minima."""
        x, low = (hashes >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(x), 512):
            m = ((x[None, at : at + 512] ^ self.xor[:, None]) * self.mul[:, None]).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        return low.astype(np.uint16)


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of compared batches, the matches below which the posterior of a link is under ``miss``."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0  # with a uniform prior, P(s >= t | m of n) = P(Binomial(n + 1, t) <= m)
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature arrays stay after the sequential comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        at = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, at] == b[alive, at]).sum(axis=1)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
    return alive


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit hash of the set), sig."""

    @common.tidy
    def sketch(batches):
        import xxhash

        hasher = Hasher(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, a, b, sigs = [], [], [], []
                for text in part.column(1).to_pylist():
                    h = hasher.hashes(text)
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    n.append(len(h))
                    a.append((d >> 64) - 2**63)
                    b.append((d & (2**64 - 1)) - 2**63)
                    sigs.append(hasher.signature(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def keys_of(sig: bytes) -> list[int]:
    """The key of each band of a signature."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(sig[i * 2 * ROWS : (i + 1) * 2 * ROWS], seed=i + 1) - 2**63 for i in range(BANDS)]


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, rep), one row for each band of each signature."""

    @common.tidy
    def bands(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = [x for s in part.column(1).to_pylist() for x in keys_of(s)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(bands, "key long, rep long")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that are links: first by signatures, then on the full sets."""
    least = least_matches(percent / 100)

    @common.tidy
    def screen(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
                at = pa.array(survivors(a, b, least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    @common.tidy
    def compare(batches):
        last, mine = None, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, links = [part.column(i).to_pylist() for i in (0, 1)], []
                for i, (a, x, y) in enumerate(zip(ids[0], part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if last != (a, x):
                        last, mine = (a, x), shingle_set(x, k)
                    other = shingle_set(y, k)
                    both = len(mine & other)
                    if both and 100 * both >= percent * (len(mine) + len(other) - both):
                        links.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in links], pa.int64()) for x in ids], names=["a", "b"])

    sig = signatures_of(reps, pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    both = common.skew_join(pairs, sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    kept = common.written(both.mapInArrow(screen, "a long, b long"), "survivors")
    texts = texts_of(docs, kept.select(F.explode(F.array("a", "b")).alias("rep")))
    # the hub's text comes second, so it is dealt to a hot hub's tasks and not shipped with every pair
    other = common.written(kept.join(texts.toDF("b", "tb"), "b"), "other-texts")
    full = common.skew_join(other, texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return common.written(full.mapInArrow(compare, "a long, b long"), "links")


def signatures_of(reps: DataFrame, asked: DataFrame) -> DataFrame:
    """(rep, sig) of the classes in asked (rep), whose numbers are written: while these are few enough to be broadcast, the
    signatures of the others aren't shuffled."""
    return reps.select("rep", "sig").join(common.written(asked.distinct(), "asked"), "rep", "left_semi")


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text), written, of the documents in reps (rep); a row for each text of a shared doc_id."""
    found = docs.select(F.col("doc_id").alias("rep"), "text").join(reps.distinct(), "rep", "left_semi")
    return common.written(found, "texts")


def first_shared(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, line, column, side, rep, c, rest): members of a bucket but its hub, dealt to groups of two blocks.

    Of a bucket with m such members, r of them outside its largest component, r * m pairs come together in a group, but only
    about (r * m + m * r) / BLOCK rows are dealt out. Buckets whose members but the hub are in one component have none.
    """
    placed = members.where("rep <> hub").join(labels, "rep", "left").select("key", "rep", F.coalesce("c", "rep").alias("c"))
    placed = common.written(placed, "placed")
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    mixed = mixed.select("key", (-F.col("top.c")).alias("main"), blocks(F.col("m")).alias("columns"), blocks(F.col("m") - F.col("top.n")).alias("lines"))
    open_ = common.written(common.skew_join(placed, mixed, "key").withColumn("rest", F.col("c") != F.col("main")), "open")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("rep", "key"), F.col(n)).cast("int")
    left = open_.where("rest").select("key", spot("lines").alias("line"), every("columns").alias("column"), F.lit(0).alias("side"), "rep", "c", "rest")
    right = open_.select("key", every("lines").alias("line"), spot("columns").alias("column"), F.lit(1).alias("side"), "rep", "c", "rest")
    return left.union(right)


class Members:
    """Members of a group's side: ids, components, signatures and band keys."""

    def __init__(self, rows: list[dict]):
        self.ids, self.parts = (np.array([r[x] for r in rows], np.int64) for x in ("rep", "c"))
        self.rest = np.array([r["rest"] for r in rows], bool)
        self.sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(-1, HASHES)
        self.keys = np.array([keys_of(r["sig"]) for r in rows], np.int64)


def open_pairs(key: int, left: Members, right: Members, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and right that their signatures leave as candidates, of those in different components whose first common
    bucket this is. Left members lie outside the largest component; two such members are compared in one order only."""
    same = left.keys[:, None, :] == right.keys[None, :, :]
    first = left.keys[np.arange(len(left.ids))[:, None], same.argmax(axis=2)] == key
    open_ = same.any(axis=2) & first & (left.parts[:, None] != right.parts[None, :]) & (~right.rest[None, :] | (left.ids[:, None] < right.ids[None, :]))
    i, j = np.nonzero(open_)
    stay = survivors(left.sigs[i], right.sigs[j], least)
    return i[stay], j[stay]


def groups(batches, flush_at: int):
    """((key, line, column), side, rows) of rows sorted by them, at most ``flush_at`` rows of side 1 at once."""
    group, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for r in batch.slice(at, 64).to_pylist():
                g = (r["key"], r["line"], r["column"], r["side"])
                if g != group or (r["side"] and len(rows) == flush_at):
                    if rows:
                        yield group[:3], group[3], rows
                    group, rows = g, []
                rows.append(r)
    if rows:
        yield group[:3], group[3], rows


def screened(dealt: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(key, line, column, side, rep, c, partners): the candidates that signatures leave, packed by group: each right member
    (side 1) with the left members that it is to be compared with, and each of those left members (side 0) once. Only
    signatures are dealt out for it, no texts."""
    least = least_matches(percent / 100)
    sent = dealt.join(signatures_of(reps, dealt.select("rep")), "rep")
    sent = sent.repartition(common.row_parallelism(dealt.sparkSession), "key", "line", "column").sortWithinPartitions("key", "line", "column", "side")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def rows_of(group, side, ids, parts, partners):
        columns = [*([x] * len(ids) for x in (*group, side)), ids, parts, partners]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["key", "line", "column", "side", "rep", "c", "partners"])

    @common.tidy
    def screen(batches):
        at, left, used = None, None, np.zeros(0, bool)
        for group, side, rows in groups(batches, 64):
            if side == 0:
                if used.any():
                    yield rows_of(at, 0, left.ids[used], left.parts[used], [None] * int(used.sum()))
                at, left = group, Members(rows)
                used = np.zeros(len(rows), bool)
            elif at == group:
                right = Members(rows)
                i, j = open_pairs(group[0], left, right, least)
                if len(i):
                    used[i] = True
                    found = np.unique(j)
                    yield rows_of(group, 1, right.ids[found], right.parts[found], [left.ids[i[j == x]].tolist() for x in found])
        if used.any():
            yield rows_of(at, 0, left.ids[used], left.parts[used], [None] * int(used.sum()))

    return common.written(sent.mapInArrow(screen, "key long, line int, column int, side int, rep long, c long, partners array<long>"), "open-pairs")


class Sets:
    """Texts of a group's left members, and the sorted hashes of all their sets with their owners."""

    def __init__(self, rows: list[dict], hasher: Hasher):
        self.at: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            self.at.setdefault(r["rep"], []).append(i)
        self.texts, self.parts = [r["text"] for r in rows], [r["c"] for r in rows]
        sets = [hasher.hashes(t) for t in self.texts]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]

    def common(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the hashes each member has."""
        lo, hi = (np.searchsorted(self.every, hashes, side) for side in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.texts))


def group_links(left: Sets, right: list[dict], hasher: Hasher, k: int, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) of right rows (rep, text, c, partners: ids of the left side), but none between components that links of
    this call have joined already."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            x = y
        return x

    out = []
    for r in right:
        mine = hasher.hashes(r["text"])
        both, b = left.common(mine), None
        for p, i in ((p, i) for p in r["partners"] for i in left.at[p]):
            if both[i] and 100 * both[i] >= percent * (left.sizes[i] + len(mine) - both[i]) and root(left.parts[i]) != root(r["c"]):
                b = shingle_set(r["text"], k) if b is None else b
                a = shingle_set(left.texts[i], k)
                n = len(a & b)
                if n and 100 * n >= percent * (len(a) + len(b) - n):
                    up[root(left.parts[i])] = root(r["c"])
                    out.append((p, r["rep"]))
    return out


def across_links(members: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members (key, rep, hub) of one bucket that labels (rep, c) leave in different components. Pairs with
    the hub have been compared before. Texts are fetched only for pairs that the signatures leave, once for a group."""
    group = ["key", "line", "column"]
    dealt = screened(first_shared(members, labels), reps, percent)
    sent = dealt.join(texts_of(docs, dealt.select("rep")), "rep")
    sent = sent.repartition(common.row_parallelism(docs.sparkSession), *group).sortWithinPartitions(*group, "side")

    @common.tidy
    def compare(batches):
        hasher, at, left = Hasher(k), None, None
        for group, side, rows in groups(batches, 64):
            if side == 0:
                at, left = group, Sets(rows, hasher)
            elif at == group:
                found = group_links(left, rows, hasher, k, percent)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return common.written(sent.mapInArrow(compare, "a long, b long"), "across")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    common.text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = common.written(sketches(docs, k), "sketches")
    full = all_.where("n_shingles > 0 and doc_id is not null")
    first = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "sig")).alias("r"))
    reps = common.written(first.select("set_a", "set_b", F.col("r.doc_id").alias("rep"), F.col("r.sig").alias("sig")), "classes")
    bands = band_keys(reps)
    shared = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("n")).where("hub <> top")
    shared = common.written(shared.select("key", "hub", "n"), "shared-keys")
    members = common.written(common.skew_join(bands, shared.select("key", "hub"), "key", counts=shared), "buckets")
    stars = common.written(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = confirmed(stars, reps, docs, k, percent)
    labels = common.written(components(links), "components")
    links = links.union(across_links(members, labels.toDF("rep", "c"), reps, docs, k, percent))
    # rows that share a doc_id are one vertex, so classes are joined by their members only where a doc_id is in two of them
    which = F.struct("set_a", "set_b")
    twice = full.groupBy("doc_id").agg(F.min(which).alias("x"), F.max(which).alias("y")).where("x <> y").select("doc_id")
    same = common.written(full.select("doc_id", "set_a", "set_b").join(twice, "doc_id", "left_semi"), "shared-ids")
    same = common.skew_join(same, reps.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("doc_id <> rep")
    links = links.union(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = common.written(components(links), "components").toDF("rep", "component")
    classes = reps.join(labels, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("class"))
    own = all_.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), F.when(F.col("n_shingles") > 0, F.col("set_b")).alias("set_b"))
    named = common.skew_join(own, classes, ["set_a", "set_b"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")))
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=2, percent=80)


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, c.c AS component_id, n.doc_id = c.c AS kept FROM n JOIN c ON n.doc_id = c.a
"""
