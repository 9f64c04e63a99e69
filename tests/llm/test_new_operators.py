import hashlib
import re

import numpy as np
import pytest

from orrery.llm import chat, html_text, minhash, toxicity, url_filter, vafile, warc


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/", None), (4, "x", ""), (None, "n", "same"), (1, "http://a/", "same"), (5, "\r\n", "\r\n\r\nWARC/1.1 é" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    found = warc.transactions(warc.read_records(warc.write_archives(df, path), path)).collect()
    assert len(found) == 7
    seen = sorted((r["metadata"][0]["page_id"] or 99, r["capture"]["type"], r["capture"]["payload_bytes"], r["capture"]["payload_digest"]) for r in found)
    want = [(p, t, len(h), warc.digest(h)) for p, t, h in [(1, "response", b"same"), (1, "revisit", b"same"), (2, "response", b""), (3, "revisit", b"same"), (4, "revisit", b""), (5, "response", ("\r\n\r\nWARC/1.1 é" * 3000).encode()), (99, "revisit", b"same")]]
    assert seen == sorted(want)
    assert all(r["request"]["concurrent_to"] == r["capture_id"] for r in found)


def test_warc_empty_table_and_query(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    none.write.mode("overwrite").parquet(p := warc.common.shared_path(spark, "e") + "/pages.parquet")
    assert warc.op1_transactions(spark, p.rsplit("/", 1)[0]).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<\\s>", "\\\\</s>", "<<s>", "<<SYS>>[INST", "[[INST]", "<|turn|>a<|text|>b<|end|>", "é\n<|end|"])
def test_escape_is_reversible_and_hides_control_strings(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    assert chat.parse_turns(chat.format_turns([(text, text), ("assistant", text)])[0]) == [(text, text), ("assistant", text)]


def test_reply_tree_paths_and_ranks(spark):
    rows = [(1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "a", 1.0), (1, 12, 10, "assistant", "b", 3.0), (1, 13, 12, "user", None, 0.0), (1, 14, 13, "assistant", "c", 9.0), (2, 20, 99, None, "r", None)]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    out = {(r["conv_id"], r["branch"]): r for r in chat.conversations(df, best=5).collect()}
    assert [t for _, t in chat.parse_turns(out[1, 1]["formatted"])] == ["q", "b", "", "c"]
    assert [t for _, t in chat.parse_turns(out[1, 2]["formatted"])] == ["q", "a"]
    assert chat.parse_turns(out[2, 1]["formatted"]) == [("", "r")] and len(out) == 3


def test_reply_chain_of_many_turns(spark):
    rows = [(7, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(37)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = chat.digests(chat.conversations(chat.chains(df))).first()
    assert row["n_turns"] == 37 and row["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()


def test_reply_cycle_raises(spark):
    df = spark.createDataFrame([(1, 1, 2, "u", "", 0.0), (1, 2, 1, "u", "", 0.0)], "conv_id long, id long, parent long, role string, text string, score double")
    with pytest.raises(ValueError):
        chat.conversations(df)


def test_va_file_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=8).round(1)], "extra") for i in range(300)]
    rows += [(300, None, ""), (301, [1.0, None] * 4, ""), (302, [float("nan")] * 8, ""), (303, [], ""), (7, rows[9][1], "repeated"), (None, rows[1][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    v = vafile.integer_vectors(df)
    found = {}
    for r in vafile.top_k(v, v.where("vec_id % 50 = 0")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(256 * np.array(x)).astype(int)) for i, x, _ in rows if i is not None and x and i < 300]
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert len(found) == 6


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q=/y", "ftp://net", "x://example.net/de/", None, "no scheme", "http://b.example.com/de/#t", "http://notnet/", "https://x.org/fr/1", "http://h?x://y/", "http://example.org/fr"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.verdicts(df).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][:3] == ("net", "", None) and got[2][2:] == ("net/", "block") and got[3][:3] == ("", "", None) == got[4][:3]
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2] is None and got[7][2:] == ("org/fr/", "allow")
    assert got[8][:2] == ("h", "") and got[9][2] is None


def test_url_models_tell_classes_apart(spark):
    rows = [(i, f"http://{'cheap-pills' if i % 2 else 'library'}{i % 97}.{'net' if i % 2 else 'org'}/{'buy' if i % 2 else 'fr'}/{i}") for i in range(600)]
    rows += [(1000 + i, f"http://{'cheap-pills' if i % 2 else 'library'}{i}.edu/{'buy' if i % 2 else 'fr'}/{i}") for i in range(40)]
    got = url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got)


def test_toxicity_generalises_to_misspellings_and_empty_tables(spark):
    plain = "the quick brown fox jumps over a lazy dog near some river bank".split()
    docs = [(i, " ".join(plain[(i + j) % 13] for j in range(12)) + (" worthless" if i % 2 else ""), "en") for i in range(400)]
    df = spark.createDataFrame(docs + [(900, None, ""), (901, "", ""), (902, "the quick fox wortthless", "")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r for r in toxicity.scores(df, model).collect()}
    assert sum(got[i]["predicted"] == i % 2 for i in range(400) if got[i]["held_out"]) >= 0.95 * sum(got[i]["held_out"] for i in range(400))
    assert got[902]["predicted"] == 1 and 0 <= got[900]["score"] == got[901]["score"] <= 1 and len(got) == 403
    none = toxicity.fit(df.where("false"), labels)
    assert toxicity.scores(df.where("false"), none).count() == 0


def test_html_blocks():
    tree = html_text.trained()
    for page in html_text.TRAINING_PAGES:
        kept = html_text.main_text(page, tree).split("\n")
        assert kept == [b[0] for b in html_text.blocks(page) if b[0].startswith("+")]
    page = '<script>var t="</p>"</script><nav><a href=x>n</a></nav><article><h1>A &amp; b</h1><p>x\n y<br>z <!-- c <p> --><p>5 < 6<p></article><footer>f</footer>'
    assert html_text.main_text(page, tree) == "A & b\nx y z\n5 < 6"
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == "" == html_text.main_text("<!-- open", tree)


def test_near_duplicates_against_brute_force(spark):
    draw = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in draw.integers(0, 400, 60)) for _ in range(12)]
    docs = [(i, re.sub(r"^\S+", f"v{i}", base[i % 12]) if i % 3 else base[i % 12]) for i in range(60)] + [(100, None), (101, ""), (102, "one"), (103, "ONE")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()}
    sets = {i: minhash.shingle_set(t, 2) for i, t in docs}
    root = {i: i for i, _ in docs}
    for _ in range(5):
        for i in root:
            for j in root:
                if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root
