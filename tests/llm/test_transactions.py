from orrery.llm import warc


def test_requests_and_identifiers_on_either_side_are_kept(spark, tmp_path):
    def rec(kind, name, *concurrent, block=b""):
        return warc.record(kind, [("WARC-Record-ID", name), *(("WARC-Concurrent-To", c) for c in concurrent), *([("WARC-Payload-Digest", f"sha1:{warc.digest(b'x')}")] if kind == "response" else [])], block)

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    archive = [
        rec("response", "r1", block=http), rec("request", "q1", "r1"), rec("request", "q2", "r1"), rec("metadata", "m1", "r1", block=b"page: 1\r\n"),
        rec("response", "r2", "q3", "m2", block=http), rec("request", "q3"), rec("metadata", "m2", block=b"page: 2\r\n"),
        rec("response", "r3", "q4", block=http), rec("request", "q4", "r3"),  # named from both sides
        rec("response", "r4", block=http), rec("metadata", "m3", "r4", "r3", "r3", block=b"page: 34\r\n"),  # one record of two captures; a repeated field
        rec("request", "q5"), rec("request", "q6", "nowhere"), rec("warcinfo", "w"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(archive))
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")
    found = {r["capture_id"]: r for r in warc.transactions(warc.read_records(files, f"file://{tmp_path}")).collect()}
    told = {k: ([x["record_id"] for x in r["requests"]], [x["page_id"] for x in r["metadata"]]) for k, r in found.items()}
    assert told == {"r1": (["q1", "q2"], [1]), "r2": (["q3"], [2]), "r3": (["q4"], [34]), "r4": ([], [34])}
    assert found["r1"]["request"]["record_id"] == "q1" and found["r4"]["request"] is None
