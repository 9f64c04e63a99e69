"""Benchmark decontamination over a distributed positional inverted index, by DataFrame operations only.

The index stores, for every term of the test set, a posting (t: number of the term, row, place) for each time that it stands
in a document. It is written as the words come, row by row, so that it needs no shuffle. Counts of its terms give each test
window its rarest ones. Offset-adjusted lists are intersected from the rarest term on: a posting of the rarest term fixes
where the item would begin, and the next rarest term has to stand at its own distance in the same row. The item's other
terms are then looked up in the postings of these rows alone, each at its own place (exact phrases) or within a slop of it
(proximity).

Joins carry no hints: Spark broadcasts a side only while its measured size is under spark.sql.autoBroadcastJoinThreshold
and deals both sides out otherwise, so a large test set works as well.

Cases: null, empty and wordless texts have no words and aren't hit; wordless items have no windows; an item repeated with
the same item_id counts once; rows that share a doc_id are judged each on its own; null item_ids are left out of the list
of items but their windows still count as hits; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that isn't in a word; upper-case letters are lower-cased before.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> F.Column:
    """Array of words; null for null."""
    ascii_ = F.octet_length(text) == F.char_length(text)  # lower() also changes other letters
    low = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAPS), "")


def word_table(docs: DataFrame) -> DataFrame:
    """row (a number of its own for each row), doc_id, words; written."""
    return common.written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words")), "words")


def windows_of(items: DataFrame, n: int) -> DataFrame:
    """item (number), item_id, words, i (first word of a window), window (its words); written."""
    rows = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    rows = common.written(rows.withColumn("item", F.xxhash64(F.col("item_id"), F.concat_ws(" ", "words"))), "items")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    cut = rows.select("item", "item_id", "words", F.explode(starts).alias("i"))
    return common.written(cut.withColumn("window", F.slice("words", F.col("i") + 1, n)), "windows")


def positional_index(table: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (row, place, t) of the terms (term, t) in all documents; written."""
    found = table.select("row", F.posexplode("words").alias("place", "term")).join(vocabulary, "term")
    return common.written(found.select("row", "place", "t"), "postings")


def probes(windows: DataFrame, terms: DataFrame) -> DataFrame:
    """item, t1, p1, t2, p2: for the windows of each item, its rarest term and the next one, with their places in the item.

    terms: term, t, n (how often it stands in the documents). Windows with a term that no document has are left out; windows
    with the same two probes are one row.
    """
    each = windows.select("item", "i", F.posexplode("window").alias("o", "term")).join(terms, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = Window.partitionBy("item", "i").orderBy("n", "term", "o")
    ranked = each.withColumn("k", F.row_number().over(best))
    probe = lambda k: F.max(F.when(F.col("k") == k, F.struct("t", (F.col("o") + F.col("i")).alias("p"))))
    some = ranked.groupBy("item", "i").agg(F.min("n").alias("least"), probe(1).alias("a"), probe(2).alias("b"))
    b = F.coalesce("b", "a")
    return common.written(some.where("least > 0").select("item", F.col("a.t").alias("t1"), F.col("a.p").alias("p1"), b["t"].alias("t2"), b["p"].alias("p2")).distinct(), "probes")


def around(column: str, slop: int) -> list[F.Column]:
    """For select: the places within slop of column, a row each."""
    return [F.explode(F.sequence(F.col(column) - slop, F.col(column) + slop)).alias("place")] if slop else [F.col(column).alias("place")]


def alignments(index: DataFrame, pairs: DataFrame, slop: int = 0) -> DataFrame:
    """row, item, shift: where the first word of an item would stand in a row, by both probes (each of them within slop)."""
    first = pairs.join(index.withColumnRenamed("t", "t1"), "t1").select("row", "item", "t2", "p1", "p2", *around("place", slop))
    first = common.written(first.select("row", "item", F.col("t2").alias("t"), (F.col("place") - F.col("p1")).alias("shift"), (F.col("place") - F.col("p1") + F.col("p2")).alias("want")).distinct(), "first-probes")
    # written, so that their size is known and the index is only dealt out where they are large
    near = index
    for column in ("t", "row"):
        near = near.join(common.written(first.select(column).distinct(), f"probed-{column}"), column, "left_semi")
    return first.select("row", "item", "t", "shift", *around("want", slop)).join(near, ["row", "t", "place"], "left_semi").select("row", "item", "shift").distinct()


def matched(index: DataFrame, found: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """row, item, shift, size, spots (map from the number of a word of the item to the places where it stands, at its own place
    or within slop of it) of every alignment (row, item, shift), from the postings; items: item, size, o, t."""
    near = common.written(index.join(found.select("row").distinct(), "row", "left_semi"), "aligned-postings")
    asked = found.join(items, "item").withColumn("own", F.col("shift") + F.col("o"))
    stood = asked.select("row", "item", "shift", "size", "o", "t", *around("own", slop)).join(near, ["row", "t", "place"])
    stood = stood.groupBy("row", "item", "shift", "size", "o").agg(F.collect_list("place").alias("at")) if slop else stood.withColumn("at", F.array("place"))
    return stood.groupBy("row", "item", "shift", "size").agg(F.map_from_entries(F.collect_list(F.struct("o", "at"))).alias("spots"))


def phrase_matches(table: DataFrame, windows: DataFrame, n: int = 10, slop: int = 0) -> DataFrame:
    """row, item, shift, hit: places (array) of the row's words inside occurrences of the item's windows.

    With a slop, each word of a window may stand up to ``slop`` words away from its own place, and hit holds the whole
    stretch between the first and the last place where one of the window's words so stands.
    """
    vocabulary = common.written(windows.select(F.explode("window").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    index = positional_index(table, vocabulary)
    terms = common.written(vocabulary.join(index.groupBy("t").agg(F.count("*").alias("n")), "t"), "terms")
    found = common.written(alignments(index, probes(windows, terms), slop), "alignments")
    items = windows.select("item", F.col("words").alias("want")).distinct().select("item", F.size("want").alias("size"), F.posexplode("want").alias("o", "term"))
    items = common.written(items.join(terms, "term").select("item", "size", "o", "t"), "wanted")
    both = matched(index, found, items, slop).withColumn("wide", F.least("size", F.lit(n)))
    # runs of words that stand: the length of the run that ends at each word, then the windows that end in a run as long
    every = F.sequence(F.lit(0), F.col("size") - 1)
    runs = F.aggregate(every, F.array().cast("array<int>"), lambda acc, i: F.concat(acc, F.array(F.when(F.map_contains_key("spots", i), F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + 1).otherwise(0))))
    hit = both.withColumn("runs", runs).withColumn("ends", F.filter(every, lambda i: F.get("runs", i) >= F.col("wide"))).where(F.size("ends") > 0)
    words_of = lambda e: F.sequence(e - F.col("wide") + 1, e)
    if slop == 0:
        places = F.transform(F.array_distinct(F.flatten(F.transform("ends", words_of))), lambda i: i + F.col("shift"))
    else:
        stood = lambda e: F.flatten(F.transform(words_of(e), lambda i: F.element_at("spots", i)))
        places = F.array_distinct(F.flatten(F.transform("ends", lambda e: F.sequence(F.array_min(stood(e)), F.array_max(stood(e))))))
    return hit.select("row", "item", "shift", places.alias("hit"))


def contamination(docs: DataFrame, items: DataFrame, *, n: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated for every row of docs."""
    table, windows = word_table(docs.select("doc_id", "text")), windows_of(items, n)
    hits = common.written(phrase_matches(table, windows, n, slop), "hits")
    names = windows.select("item", F.col("item_id").cast("string").alias("id")).distinct()
    ids = hits.select("row", "item").distinct().join(names, "item").groupBy("row").agg(F.sort_array(F.collect_set("id")).alias("item_ids"))
    spots = hits.select("row", F.explode("hit").alias("place")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    found = spots.join(ids, "row", "left")
    out = table.select("row", "doc_id", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words")).join(found, "row", "left")
    return out.select(
        "doc_id", F.greatest("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_W}, []) AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i + 1:i + least(len(w), 10)], ' ') FOR i IN range(greatest(len(w) - 9, 1))]) AS g FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM g),
s AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
