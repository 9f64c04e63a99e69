"""Readers, sinks, logs, reports and the command line."""

import json

import pytest

from orrery import cli, harness
from orrery.operators import benchmark, encode, knn, prep
from orrery.sources import logs, tables


def put(path, text):
    path.write_text(text)
    return str(path)


def test_matrix_scan_is_typed_skips_blank_lines_and_checks_its_width(spark, tmp_path):
    path = put(tmp_path / "a.csv", "a,round_winner,b\n1, -1 ,2.5\n\n   \nx,1,\n3,1,4\r\n")
    df = tables.read_matrix(spark, path, "round_winner", default=0)
    assert df.dtypes == [("a", "float"), ("b", "float"), ("round_winner", "int")]
    assert sorted(map(tuple, df.collect())) == [(0.0, 0.0, 1), (1.0, 2.5, -1), (3.0, 4.0, 1)]
    with pytest.raises(Exception, match="no number in column"):
        tables.read_matrix(spark, path, "round_winner").collect()
    for i, body in enumerate(("1,2\n", "1,2,3,4\n")):
        with pytest.raises(Exception, match="expected 3 fields"):
            tables.read_matrix(spark, put(tmp_path / f"b{i}.csv", f"a,round_winner,b\n{body}"), "round_winner").select("a").collect()
    with pytest.raises(ValueError):
        tables.read_matrix(spark, path, "no_such")
    assert tables.read_matrix(spark, put(tmp_path / "c.csv", "a,y\n"), "y").count() == 0


@pytest.mark.parametrize("start, end", [('"a","y"', "\n"), ("\ufeffa,y", "\n"), ("a,y", "\r\n"), ('\ufeff"a","y"', "\r\n")])
def test_header_is_dropped_by_its_place(spark, tmp_path, start, end):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_bytes(end.join([start, f"{i}.5,1", "2,-1", ""]).encode())
    df = tables.read_matrix(spark, str(folder), "y")
    assert sorted(map(tuple, df.collect())) == [(0.5, 1), (1.5, 1), (2.0, -1), (2.0, -1)]


def test_paths_are_looked_for_in_order(tmp_path, monkeypatch):
    (tmp_path / "data").mkdir()
    (tmp_path / "sub").mkdir()
    put(tmp_path / "data" / "x.csv", "")
    monkeypatch.chdir(tmp_path / "sub")
    assert tables.resolved("x.csv") == "../data/x.csv" and tables.resolved("none.csv") == "none.csv" and tables.resolved("s3://b/x.csv") == "s3://b/x.csv"


ROW = ("svm", "serial", 1, 1.234, 2.0, 3.234, 0.98765, 0.5, 0.25, 1 / 3)


def test_sinks_round_append_and_extend(spark, tmp_path):
    rows = spark.createDataFrame([ROW], benchmark.BENCHMARK)
    tables.write_benchmark(rows, f"{tmp_path}/bench")
    tables.write_benchmark(rows, f"{tmp_path}/bench")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/bench").collect()] == [("svm", "serial", "1", "1.23", "2.00", "3.23", "0.9877", "0.5000", "0.2500", "0.3333")]
    told = spark.createDataFrame([("svm", "f", "default", 1, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 'a, "quoted" note')], benchmark.HARNESS)
    tables.append_rows(told, f"{tmp_path}/harness")
    tables.append_rows(told, f"{tmp_path}/harness")
    again = tables.read_csv(spark, f"{tmp_path}/harness", benchmark.HARNESS)
    assert again.count() == 2 and again.first()["notes"] == 'a, "quoted" note'
    both = tables.sweep_pair(spark, f"{tmp_path}/bench", f"{tmp_path}/harness")
    assert benchmark.combined(*both).count() == 3 and tables.union_files(spark, [f"{tmp_path}/harness"] * 2, benchmark.HARNESS).count() == 4
    path = tmp_path / "r.json"
    assert tables.extend_json([{"a": 1}], str(path)) == 1 and tables.extend_json([{"a": 2}], str(path)) == 2
    path.write_text("{broken")
    assert tables.extend_json([{"a": 3}], str(path)) == 1 and json.loads(path.read_text()) == [{"a": 3}]
    path.write_text('{"no": "list"}')
    assert tables.extend_json([], str(path)) == 0


LOG = """Dataset Info
  Accuracy       : 0.1
[Serial SVM]
  Training time  : 80.00 ms
  Inference time : 2.13 ms
  Total time     : 82.13 ms
  Accuracy       : 0.7301

epoch 0  lr=0.01  loss=0.6
  Recall         : 0.9
[Parallel SVM (OpenMP, 4 threads)]
  Training time  : nothing
  F1 Score       : 0.7245
  Accuracy parity check : 0.0
[Parallel DT (pthreads)]
[Serial XYZ]
  Accuracy       : 0.4
"""


def test_logs_by_both_readers(spark, tmp_path):
    lines = logs.read_lines(spark, put(tmp_path / "x.log", LOG))
    assert lines.count() == len(LOG.splitlines())
    strict = {r["block"]: r for r in logs.parse_strict(lines).collect()}
    assert [(r["algorithm"], r["variant"], r["n_threads"]) for _, r in sorted(strict.items())] == [("svm", "serial", 1), ("svm", "omp", 4), ("dt", "pthreads", 8)]
    assert (strict[2]["train_ms"], strict[2]["accuracy"], strict[2]["recall"]) == (80.0, 0.7301, 0.0)  # the unindented line ends the block
    assert (strict[10]["train_ms"], strict[10]["f1"], strict[10]["accuracy"]) == (0.0, 0.7245, 0.0)
    loose = {r["block"]: r for r in logs.parse_loose(lines).collect()}
    assert [(r["algorithm"], r["n_threads"], r["rec"]) for _, r in sorted(loose.items())] == [("svm", 1, 0.9), ("svm", 4, 0.0), ("xyz", 1, 0.0)]
    assert logs.parse_strict(lines.where("false")).count() == 0


def test_logs_in_splits_and_segments_equal_the_whole_file(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "long.log", LOG * 300)
    both = lambda: [sorted(map(tuple, p(logs.read_lines(spark, path)).collect())) for p in (logs.parse_strict, logs.parse_loose)]
    want = both()
    assert len(want[0]) == len(want[1]) == 900
    monkeypatch.setattr(logs, "SEGMENT", 7)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        assert both() == want
        lines = {r["line"]: r["text"] for r in logs.read_lines(spark, path).collect()}
    finally:
        spark.conf.set(key, old)
    assert [lines[i] for i in range(len(lines))] == (LOG * 300).splitlines()


def test_output_of_a_command_is_a_source(spark):
    found = logs.command_lines(spark, ["sh", "-c", "echo '[Serial NB]'; echo '  Accuracy : 0.5' ; echo oops >&2"])
    assert found.count() == 3 and logs.parse_strict(found).first()["algorithm"] == "nb"


def test_result_block_is_read_back(spark):
    text = benchmark.result_block(spark.createDataFrame([ROW], benchmark.BENCHMARK)).first()["block"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line int, text string")
    row = logs.parse_strict(lines).first()
    assert (row["algorithm"], row["train_ms"], row["accuracy"], row["f1"]) == ("svm", 1.23, 0.9877, 0.3333)


def test_sanity_check_raises(spark):
    good = ("svm", "f", "d", 1, 1.0, 0.0, 0.5, 0.5, 0.5, 0.5, "")
    for at, value in ((4, 0.0), (6, 1.5), (6, float("nan")), (7, float("inf")), (8, None)):
        bad = [*good]
        bad[at] = value
        with pytest.raises(ValueError):
            benchmark.checked(spark.createDataFrame([tuple(bad)], benchmark.HARNESS))
    assert benchmark.checked(spark.createDataFrame([good], benchmark.HARNESS)).count() == 1
    assert benchmark.known(spark.createDataFrame([ROW, ("unknown", *ROW[1:])], benchmark.BENCHMARK)).count() == 1


def test_speedups_without_a_row_or_with_zero_times_are_null(spark):
    rows = [(0, "svm", "serial", 4.0), (1, "svm", "serial", 2.0), (2, "svm", "omp", 0.0), (3, "nb", "omp", 1.0)]
    found = {r["algorithm"]: r for r in benchmark.speedups(spark.createDataFrame(rows, "seq long, algorithm string, variant string, total_ms double"), "seq").collect()}
    assert (found["svm"]["serial_ms"], found["svm"]["omp_speedup"], found["nb"]["omp_speedup"]) == (2.0, None, None)


def test_encodings_of_values_not_seen_in_training(spark):
    train, test = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "m string, n int"), spark.createDataFrame([("c", 1), ("a", 2), (None, 3)], "m string, n int")
    values = encode.categories(train, "m")
    assert values == ["a", "b"] and encode.one_hot(test, "m", values).columns == ["n", "m_a", "m_b"]
    assert [tuple(r) for r in encode.one_hot(test, "m", values).orderBy("n").collect()] == [(1, 0, 0), (2, 1, 0), (3, 0, 0)]
    assert [r["m"] for r in encode.label_encode(test, "m", values).orderBy("n").collect()] == [None, 0, None]


def test_describe_of_nulls_and_of_no_rows(spark):
    rows = {r["feature"]: r for r in prep.describe(spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "x double, z double"), ["x", "z"]).collect()}
    assert tuple(rows["x"])[1:] == (3, 7 / 3, pytest.approx(1.527525), 1.0, 1.5, 2.0, 3.0, 4.0) and tuple(rows["z"])[1:] == (0, *[None] * 7)
    assert prep.describe(spark.createDataFrame([], "x double"), ["x"]).first()["count"] == 0


def test_a_failing_job_is_left_out(spark):
    df = spark.createDataFrame([(float(i), 1 if i > 4 else -1) for i in range(40)], "x float, y int")
    jobs = [harness.Job("svm", "ours", "broken", lambda t: 1 / 0), *harness.own_jobs(["x"], ["x"])[:1]]
    rows = harness.run(jobs, df, df)
    assert [r["algorithm"] for r in rows] == ["svm"] and benchmark.checked(harness.rows_frame(spark, rows)).count() == 1
    with pytest.raises(RuntimeError):
        harness.run(jobs[:1], df, df)
    assert harness.thread_budget("knn", 8)["OMP_NUM_THREADS"] == "1" and harness.thread_budget("mlp", 8)["OMP_NUM_THREADS"] == "8" and harness.thread_budget("svm", 8) == {}
    assert harness.threads_of({"N_THREADS": "0"}) == 1 and harness.threads_of({"N_THREADS": "x"}) == 8


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda kind: spark)
    body = "\n".join(f"{i % 10},{i % 2},{1 if i % 10 > 4 else -1}" for i in range(60))
    train = test = put(tmp_path / "t.csv", f"a,map_x,round_winner\n{body}\n")
    for algorithm, values in (("svm", ["5", "bad"]), ("knn", ["3"]), ("dt", []), ("nb", []), ("mlp", ["1"])):
        cli.main([algorithm, train, test, *values])
        assert "Training time" in (said := capsys.readouterr().out) and f"[Serial {algorithm.upper()}]" in said
    cli.main(["analytics", train, test, f"{tmp_path}/out"])
    said = capsys.readouterr().out
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 10 and "omp_speedup" in said and "alike" in said
    cli.main(["compare", "--train", train, "--test", test, "--out-csv", f"{tmp_path}/cmp", "--out-json", f"{tmp_path}/cmp.json"])
    assert {(r["algorithm"], r["variant"]) for r in json.loads((tmp_path / "cmp.json").read_text())} == {("svm", "sgd"), ("knn", "spark"), ("mlp", "minibatch"), ("dt", "exact"), ("dt", "boosted"), ("nb", "hybrid"), ("nb", "gaussian"), ("nb", "bernoulli")}
    log = put(tmp_path / "l.log", LOG)
    cli.main(["ingest", log, f"{tmp_path}/missing.log", "--append", f"{tmp_path}/res", "--json", f"{tmp_path}/res.json"])
    assert len(json.loads((tmp_path / "res.json").read_text())) == 3
    assert cli.params_of("svm", ["x", "0.5"]).lr == 0.5


def test_block_sizes_come_from_the_environment(monkeypatch):
    assert [harness.block_of("B", 9, {"B": v}) for v in ("4", "0", "-1", "x", "")] == [4, 9, 9, 9, 9] and harness.block_of("B", 9, {}) == 9
    for name in ("KNN_BLAS_BLOCK", "MLP_BLAS_BLOCK"):
        monkeypatch.delenv(name, raising=False)
    assert (cli.params_of("knn", ["5"]).block, cli.params_of("mlp", []).block) == (256, 512)
    monkeypatch.setenv("KNN_BLAS_BLOCK", "64")
    monkeypatch.setenv("MLP_BLAS_BLOCK", "32")
    assert cli.params_of("knn", ["5"]) == knn.Params(5, 64) and cli.params_of("mlp", []).block == 32
