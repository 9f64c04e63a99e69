"""The pipeline's stages against brute force, scores by hand, and joins with a hot key."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import chat, common, minhash, tokens, toxicity, warc

PLAIN = "the quick brown fox jumps over a lazy dog near some river bank where old trees grow".split()
BENCH = [(1, "one two three four five six seven eight nine ten eleven"), (2, "tiny item"), (3, None), (4, "...")]


def documents():
    draw = np.random.default_rng(5)
    rows = []
    for i in range(260):
        text = " ".join(draw.choice(PLAIN, 30)) + (" worthless scum" * 4 if i % 4 == 0 else "")
        rows.append((i, text))
    base = [f"w{x}" for x in draw.integers(0, 500, 80)]
    for i in range(300, 330):  # near copies
        text = list(base)
        text[int(draw.integers(0, 80))] = f"v{i}"
        rows.append((i, " ".join(text)))
    rows += [(400, "x One two, three four five six seven eight nine ten y"), (401, "one two three four five six seven eight nine"), (402, "a Tiny ITEM b"), (None, "tiny item"), (None, "alone one"), (7, "shared id"), (7, "shared id"), (500, None), (501, ""), (502, " \n")]
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(d, t, "en", "s", len(t or "")) for d, t in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text):
    w = words(text)
    for _, item in BENCH:
        b = words(item)
        n = min(len(b), 10)
        for i in range(len(b) - n + 1 if n else 0):
            if any(w[j : j + n] == b[i : i + n] for j in range(len(w) - n + 1)):
                return True
    return False


def shown(rows):
    return sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows)


def test_each_stage_against_brute_force_on_its_own_input(spark, corpus):
    docs = common.table(spark, corpus, "documents")
    kept = corpus_pipeline.toxicity_stage(spark, docs, corpus)
    assert kept.columns == docs.columns
    first = [tuple(r)[:2] for r in kept.collect()]
    gone = set(shown(documents())) - set(shown(first))
    assert len([d for d, _ in gone if d % 4 == 0 and 0 <= d < 260]) >= 60 and len(gone) <= 66

    second = corpus_pipeline.near_duplicate_stage(spark, common.written(kept, "stage"), corpus)
    assert second.columns == docs.columns
    sets = [minhash.shingle_set(t, 5) for _, t in first]
    root = list(range(len(first)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(first)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[top(i)] = top(j)
    groups = {}
    for i, row in enumerate(first):
        groups.setdefault(top(i), []).append(row)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert [d for d, _ in shown(r[:2] for r in second.collect())] == [d for d, _ in shown(want)]

    third = corpus_pipeline.decontamination_stage(spark, common.written(second, "stage"), corpus)
    assert third.columns == docs.columns
    assert [d for d, _ in shown(r[:2] for r in third.collect())] == [d for d, _ in shown(r for r in want if not contaminated(r[1]))]

    last = corpus_pipeline.packing_stage(spark, common.written(third, "stage"), corpus).collect()
    ids = lambda t: [*tokens.encoder(tokens.default_tokenizer()).tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in last) == sorted((d or -1, zlib.crc32(np.asarray(ids(t), "<u4").tobytes())) for d, t in ((r[0], r[1]) for r in third.collect()))
    assert corpus_pipeline.run(spark, corpus).count() == len(last)


def test_scores_are_the_softmax_of_averaged_bags(spark, corpus):
    model = toxicity.fit(common.table(spark, corpus, "documents"), common.table(spark, corpus, "labels"))
    for text in (None, "", "worthless fox", "Wörthless scum 12", "x" * 5000):
        found = toxicity.words_of(text)
        z = model.bias + (sum(np.mean([model.logit[b] for b in toxicity.subwords(w)]) for w in found) / len(found) if found else 0.0)
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert model.score("wrothless skum worthles") > 0.5 > model.score("a fox and some trees")


def test_the_sample_is_bounded_and_keeps_out_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(900)] + [(3, f"again {i}") for i in range(50)] + [(2000, "y" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)] + [(2000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.sample(docs, labels, 40, 50).collect()
    assert sorted(r["toxic"] for r in found) == [0] * 40 + [1] * 40
    assert all(zlib.crc32(r["text"][1:].encode()) % 3 != 1 for r in found if r["text"][0] == "t")
    assert toxicity.sample(docs, labels.where("false")).count() == 0


def test_hot_keys_join_like_any_other(spark):
    left = common.written(spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50).alias("k"), "id"), "left")
    left = common.written(left.union(spark.createDataFrame([(None, 9999)], "k long, id long")), "left")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (77, "d")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.skew_join(left, right, "k", how).select("k", "id", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))


def test_captures_against_brute_force(spark):
    rows = [(i, f"u{i}", None if i % 11 == 0 else "same" if i % 3 else f"page {i % 40}") for i in range(700)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, row string").repartition(5)
    path = common.shared_path(spark, "warc")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.captures(warc.transactions(warc.read_records(warc.write_archives(df, path), path))).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    for i, _, html in rows:
        f = first[html or ""]
        assert got[i] == (len(html or ""), warc.digest((html or "").encode()), "response" if f == i else "revisit", None if f == i else f)
    assert len(got) == 700


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.conversations(chat.chains(none))).count() == 0


def test_a_stage_frees_what_the_one_before_has_made_but_not_what_docs_read(spark, tmp_path):
    common, at = corpus_pipeline.common, {}

    def first(s, docs, sf_dir):
        at["table"] = common.written(docs, "first")
        return at["table"]

    one = corpus_pipeline.freed("one", None, first)
    two = corpus_pipeline.freed("two", "one", lambda s, docs, sf_dir: docs)
    docs = one(spark, spark.range(5), "")
    assert two(spark, docs, "").count() == 5  # docs not written again: they stay
    one(spark, spark.range(5), "").write.parquet(f"{tmp_path}/again")
    assert two(spark, spark.read.parquet(f"{tmp_path}/again"), "").count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND|FAILED_READ_FILE"):
        at["table"].count()
    with pytest.raises(ValueError):
        corpus_pipeline.numbered(spark.range(1).withColumnRenamed("id", corpus_pipeline.ROW))


def test_empty_documents_give_no_sequences(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("false" if name == "documents" else "true").write.parquet(f"{tmp_path}/{name}.parquet")
    try:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    except ValueError as e:
        assert "label" in str(e)  # no labelled document to train on


def test_few_rows_are_taken_out_without_a_shuffle_of_texts(spark):
    rows = corpus_pipeline.numbered(spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id long, text string").coalesce(1))
    gone = spark.range(10_000_000).where("id % 9999999 = 3").select(F.col("id").alias(corpus_pipeline.ROW))  # few rows, of unknown size before
    left = corpus_pipeline.without(rows, gone)
    assert sorted(r[0] for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7, 8] and left.columns == ["doc_id", "text"]
    assert "SortMergeJoin" not in (plan := left._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan
