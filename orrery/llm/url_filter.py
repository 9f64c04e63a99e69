"""URL verdicts: host and path rules, and for the other URLs a ratio of character language models.

Two variable-order Markov models over bytes (orders 0 to ORDER; to the counts of each order, ALPHA more are added in the
proportions of the next lower one) are counted from all URLs that the rules accept and reject. A URL is blocked if its length-normalised log-likelihood
difference (rejected less accepted, nats a byte) is above a threshold: the cut with the smallest sum of both error rates on a
fifth of these URLs (by hash of the url) under models counted from the others alone. The models are counted, calibrated and
applied on the whole url; host and path serve the rules alone.

Counts are exact, in tables that grow with the corpus. What a byte adds to the difference is fixed by its gram (itself and the
ORDER bytes before it), so each gram in use is worked out once, order by order, in joins whose keys have 257 rows at most, and
a URL is the sum over its grams. Grams that make up more than 1 / HOT of all bytes are sent to the tasks (fewer than HOT rows),
all others are joined. Sums are of whole numbers, so they don't depend on the order of rows.

Cases: a null URL, or one without "://", has an empty host and path; a null or empty URL has the difference 0 and is allowed,
as nothing speaks against it; without accepted or without rejected URLs no URL but by rule is blocked; without either of them
in the fifth or in the others the threshold is 0; of rules of equal length the first in order wins; repeated rows are counted and judged each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import common

ORDER, ALPHA = 5, 4.0
#: Grams sent to the tasks; parts of a nat that sums are counted in; bits of a symbol.
HOT, UNIT, BITS = 1 << 15, 1 << 32, 9
BINS, SPAN = 4000, 20.0
#: (verdict, host, path): the host and its subdomains, paths that start with path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url) -> tuple[F.Column, F.Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and by_rule (verdict) to rows with url."""
    host, path = parts(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last that fits stands
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, index of its text) of every byte; the byte itself is lowest (1 to 256), 0 stands for what is before the text."""
    size = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    gram = x.copy()
    for k in range(1, ORDER + 1):
        gram |= np.where(place >= k, np.roll(x, k), 0) << BITS * k
    return gram, np.repeat(np.arange(len(texts)), size)


def gram_counts(labelled: DataFrame, asked: DataFrame) -> DataFrame:
    """gram, n0 (accepted), n1 (rejected) from all rows of labelled (text, label), times from all rows of asked (text); written."""

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                gram, row = grams(part.column(0).to_pylist())
                kind = part.column(1).to_numpy()[row]
                found, where = np.unique(gram, return_inverse=True)
                n = [np.bincount(where, kind == c, len(found)).astype(np.int64) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, n)], names=["gram", "n0", "n1", "times"])

    texts = labelled.select(F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"))
    texts = texts.unionAll(asked.select(F.col("text").cast("binary"), F.lit(2)))
    some = texts.mapInArrow(count, "gram long, n0 long, n1 long, times long")
    return common.written(some.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "times"))), "grams")


def weights(counted: DataFrame) -> DataFrame:
    """gram, times, units (log-likelihood under the rejected model less that under the accepted one) of all grams asked for; written."""
    p = None
    for k in range(ORDER + 1):
        level = counted
        if k < ORDER:
            level = level.groupBy(F.col("gram").bitwiseAND((1 << BITS * (k + 1)) - 1).alias("gram")).agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "times")))
        context = Window.partitionBy(F.shiftright("gram", BITS))
        level = level.select("*", *(F.sum(f"n{c}").over(context).alias(f"all{c}") for c in (0, 1))).where("times > 0")
        if p is None:
            level = level.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            level = level.withColumn("lower", F.col("gram").bitwiseAND((1 << BITS * k) - 1)).join(p, "lower")
        level = level.withColumns({f"p{c}": (F.col(f"n{c}") + ALPHA * F.col(f"q{c}")) / (F.col(f"all{c}") + ALPHA) for c in (0, 1)})
        p = level.select(F.col("gram").alias("lower"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    return common.written(level.select("gram", "times", F.round((F.log("p1") - F.log("p0")) * UNIT).cast("long").alias("units")), "weights")


def differences(asked: DataFrame, labelled: DataFrame) -> DataFrame:
    """row, difference (a byte) of every row of asked (row, text) under the models of labelled (text, label); written."""
    found = weights(gram_counts(labelled, asked))
    total = found.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") * HOT > total
    hot = found.where(often).select("gram", "units").orderBy("gram").toArrow()  # fewer than HOT rows
    sent = asked.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(), hot["units"].to_numpy()))

    def look(batches):
        keys, units = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row = part.column(0).to_numpy()
                gram, i = grams(part.column(1).to_pylist())
                place = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
                here = keys[place] == gram if len(keys) else np.zeros(len(gram), bool)
                known = np.zeros(len(row), np.int64)
                np.add.at(known, i[here], units[place[here]])
                # a row's own sum has a key of its own that is no gram
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((row, row[i[~here]]), (-1 - row, gram[~here]), (known, np.zeros((~here).sum(), np.int64)))], names=["row", "gram", "known"])

    parts_ = asked.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(look, "row long, gram long, known long")
    sums = parts_.join(found.where(~often).select("gram", "units"), "gram", "left").groupBy("row").agg(F.sum(F.col("known") + F.coalesce("units", F.lit(0))).alias("sum"))
    size = F.octet_length("text")
    value = F.when(size > 0, F.col("sum") / UNIT / size).otherwise(0.0)
    return common.written(asked.join(sums, "row").select("row", value.alias("difference")), "differences")


def calibrated(judged: DataFrame) -> float:
    """The cut with the smallest sum of both error rates over all rows (difference, label); counted in BINS bins of SPAN nats."""
    at = F.least(F.greatest((F.col("difference") / SPAN + 0.5) * BINS, F.lit(0.0)), F.lit(BINS - 1.0)).cast("int")
    table = np.zeros((2, BINS))
    for b, label, n in judged.select(at.alias("bin"), "label").groupBy("bin", "label").count().collect():
        table[label, b] = n
    if not table.sum(axis=1).all():
        return 0.0
    share = table / table.sum(axis=1, keepdims=True)
    errors = np.array([share[0, i:].sum() + share[1, :i].sum() for i in range(BINS + 1)])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float((best[len(best) // 2] / BINS - 0.5) * SPAN)


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, difference (null where a rule fits) for every row of pages (page_id, url)."""
    rows = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), rules)
    rows = rows.withColumns({"text": F.coalesce("url", F.lit("")), "label": (F.col("by_rule") == "block").cast("int"), "row": F.monotonically_increasing_id()})
    rows = common.written(rows.drop("url"), "urls")
    known, open_ = rows.where("label is not null"), rows.where("label is null")
    apart = F.crc32(F.col("text").cast("binary")) % 5 == 0
    held, kept = known.where(apart), known.where(~apart)
    both = lambda some: some.where("text != ''").select("label").distinct().count() == 2
    cut = float("inf") if not both(known) else calibrated(held.join(differences(held, kept), "row")) if both(kept) else 0.0
    found = differences(open_, known)
    said = F.when((F.col("text") != "") & (F.col("difference") > cut), "block").otherwise("allow")
    judged = rows.join(found, "row", "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", said).alias("verdict"), F.when(F.col("label").isNull(), F.col("difference")).alias("difference")
    )


def op6_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(common.table(spark, sf_dir, "pages"))
