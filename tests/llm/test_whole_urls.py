from orrery.llm import url_filter


def test_url_models_read_query_and_fragment(spark):
    end = lambda i: ("?offer=cheap-pills", "#cheap-pills")[i // 2 % 2] if i % 2 else ("?book=library", "#library")[i // 2 % 2]
    rows = [(i, f"http://h{i % 97}.{'net' if i % 2 else 'org'}/fr/{end(i)}{i}") for i in range(600)]
    rows += [(1000 + i, f"http://h.edu/x/{end(i)}{i}") for i in range(40)] + [(2000 + i, f"{end(i)}{i}") for i in range(40)]
    got = url_filter.verdicts(spark.createDataFrame([*rows, (3000, None), (3001, "")], "page_id long, url string")).where("page_id >= 1000").collect()
    assert len(got) == 82
    assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got if r["page_id"] < 3000)
    assert len({r["difference"] for r in got if 2000 <= r["page_id"] < 3000}) > 20
    assert all((r["verdict"], r["difference"]) == ("allow", 0) for r in got if r["page_id"] >= 3000)
