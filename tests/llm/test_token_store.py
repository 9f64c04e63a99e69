import numpy as np
import pytest

from orrery.llm import token_store


def test_sample_comes_from_all_rows(spark):
    rows = [(i, ("front" if i < 500 else "behind") + f" {i}") for i in range(1000)] + [(1000, None), (1001, ""), (1002, "long " * 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    encode = token_store.encoder(token_store.default_tokenizer()).encode
    front = {np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in encode([t for _, t in rows[:500]])}
    got = token_store.sample_ids(df, token_store.default_tokenizer(), 2, 100, 50)
    assert len(got) == 100 and 20 < sum(x in front for x in got) < 80
    assert got == token_store.sample_ids(df.repartition(7), token_store.default_tokenizer(), 2, 100, 50)
    assert token_store.sample_ids(df.where("false"), token_store.default_tokenizer(), 2, 100, 50) == []


@pytest.mark.parametrize("end_id", [2, 70_000])
def test_ids_read_back_whatever_the_end_id(spark, tmp_path, end_id):
    texts = [(1, "some words"), (2, None), (None, "é")]
    path = f"file://{tmp_path}/s"
    index = token_store.write_shards(spark.createDataFrame(texts, "doc_id long, text string"), path, end_id=end_id)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read_shards(index, path).collect()}
    want = token_store.encoder(token_store.default_tokenizer()).encode([t for _, t in texts])
    assert got == {i: np.frombuffer(x, "<u4").tolist() + [end_id] for (i, _), x in zip(texts, want)}


def test_width_that_does_not_fit_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        token_store.write_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), f"file://{tmp_path}/s", end_id=70_000, width=2)


def words(spark, n=600):
    rows = [(i, f"document {i} with some words {i * 7} and more of them") for i in range(n)] + [(5, "the id again"), (None, "no id"), (None, None), (n, "long words " * 20_000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_a_document_is_read_from_a_file_alone(spark, tmp_path):
    rows, df = words(spark)
    path = f"file://{tmp_path}/s"
    shards = token_store.write_shards(df, path, shards=3).collect()
    assert sum(r["documents"] for r in shards) == len(rows) and {r["dict_sha256"] for r in shards} != {"00" * 32}
    encode = token_store.encoder(token_store.default_tokenizer()).encode
    for doc in (0, 5, 299, 600, None):
        want = sorted(np.frombuffer(x, "<u4").tolist() + [2] for x in encode([t for i, t in rows if i == doc]))
        got = sorted(x.tolist() for r in shards for x in token_store.read_document(r["path"], path, doc))
        assert got == want
    assert token_store.read_document(shards[0]["path"], path, 10**9) == []


def test_a_failing_task_leaves_no_shard_and_a_cut_file_is_no_shard(spark, tmp_path):
    _, df = words(spark)
    bad = df.selectExpr("doc_id", "if(doc_id = 77, raise_error('broken row'), text) as text")
    with pytest.raises(Exception, match="broken row"):
        token_store.write_shards(bad, f"file://{tmp_path}/bad", shards=2, sample_chars=0)
    assert list(tmp_path.glob("bad/*.ids")) == []
    shards = token_store.write_shards(df, f"file://{tmp_path}/s", shards=2).collect()
    assert list(tmp_path.glob("s/*.part")) == [] and len(list(tmp_path.glob("s/*.ids"))) == 2
    cut = tmp_path / "s" / "cut.ids"
    with open(shards[0]["path"], "rb") as f:
        cut.write_bytes(f.read()[:-30])
    with pytest.raises(ValueError, match="no whole shard"):
        token_store.read_document(str(cut), f"file://{tmp_path}/s", 1)


def test_an_error_while_storing_removes_the_unfinished_file(spark, tmp_path, monkeypatch):
    _, df = words(spark, 50)
    # the index can't be written: the tasks fail after the frames
    monkeypatch.setattr(token_store, "_FOOT", "<no format")
    with pytest.raises(Exception, match="struct|format|error"):
        token_store.write_shards(df, f"file://{tmp_path}/s", shards=1)
    assert list(tmp_path.glob("s/*.ids*")) == []


def test_too_few_samples_give_no_dictionary():
    assert token_store.train_dictionary([]) == b"" and token_store.train_dictionary([b"ab"]) == b""
    many = [bytes([i % 7, 0, i % 11, 1]) * 40 for i in range(500)]
    assert token_store.train_dictionary(many, 4096)
