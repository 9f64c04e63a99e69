"""Result logs as tables: text lines with their number, tags, blocks and the rows that the blocks report.

A tag line opens a block. The strict reader ends a block at the next tag and at an unindented line that it doesn't know; the
loose reader takes every indented metric up to the next tag. Files may be read in splits: what a block needs of the lines before
it is found by scans over segments.
"""

from __future__ import annotations

import string
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery import storage
from orrery.functions import scalar

#: Lines of a segment of the scans.
SEGMENT = 10_000

#: Labels of the metrics in a block, in the order of their columns.
METRICS = {"Training time": "train_ms", "Inference time": "infer_ms", "Total time": "total_ms", "Accuracy": "accuracy", "Precision": "precision", "Recall": "recall", "F1 Score": "f1"}
#: What a tag holds for each algorithm; the first that fits counts.
NEEDLES = [("SVM", "svm"), ("KNN", "knn"), ("MLP", "mlp"), (" DT", "dt"), (" NB", "nb")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), text of every line of the text files under path.

    A file may be read in splits by several tasks; a split's lines are numbered on their own and offset by those before it.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("text"))
    raw = storage.written(raw, "lines")
    counts = raw.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    first = counts.select("file", "split", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    return raw.withColumn("n", local).join(first, ["file", "split"]).select("file", (F.col("n") + F.col("before") - 1).cast("int").alias("line"), "text")


def command_lines(spark: SparkSession, command: list[str], env: dict[str, str] | None = None) -> DataFrame:
    """file (the command), line, text of what a command prints, errors included; runs on the driver."""
    said = subprocess.run(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, env=env, check=False).stdout
    return spark.createDataFrame([(" ".join(command), i, x) for i, x in enumerate(said.splitlines())], "file string, line int, text string")


def classified(tag: Column) -> tuple[Column, Column, Column]:
    """(algorithm, variant, n_threads) of a tag; 1 thread for serial ones, 8 where a tag names none."""
    algorithm = F.lit("unknown")
    for needle, name in reversed(NEEDLES):
        algorithm = F.when(tag.contains(needle), name).otherwise(algorithm)
    variant = F.when(tag.contains("pthreads"), "pthreads").when(tag.contains("OpenMP"), "omp").when(tag.contains("Serial"), "serial").otherwise("unknown")
    said = F.regexp_extract(tag, r"(\d+)\s* threads", 1).try_cast("int")
    return algorithm, variant, F.when(variant == "serial", 1).otherwise(F.coalesce(said, F.lit(8)))


def _running(lines: DataFrame, **marks: Column) -> DataFrame:
    """lines with, for each mark, the last line up to each one that has it (null before the first).

    A segmented scan: segments of SEGMENT lines find their own last marks, and those of the segments before are handed on, a
    row for each segment, so a long file isn't one task's.
    """
    lines = lines.withColumns({"_segment": F.floor(F.col("line") / SEGMENT), **{f"_{n}": F.when(m, F.col("line")) for n, m in marks.items()}})
    own = Window.partitionBy("file", "_segment").orderBy("line")
    ends = lines.groupBy("file", "_segment").agg(*(F.max(f"_{n}").alias(f"_{n}") for n in marks))
    before = Window.partitionBy("file").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("file", "_segment", *(F.max(f"_{n}").over(before).alias(f"_before_{n}") for n in marks))
    found = lines.withColumns({n: F.max(f"_{n}").over(own) for n in marks}).join(handed, ["file", "_segment"])
    return found.withColumns({n: F.greatest(n, f"_before_{n}") for n in marks}).drop("_segment", *(f"_{n}" for n in marks), *(f"_before_{n}" for n in marks))


def reading(text: Column) -> tuple[Column, Column]:
    """(label, what follows) of a line "label : value", trimmed."""
    label = F.substring_index(text, ":", 1)
    return F.trim(label), F.trim(F.substr(text, F.length(label) + 2))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), " "), lambda w: w != "")


def tag_parts(text: Column) -> tuple[Column, Column, Column, Column]:
    """(whether a line opens with a whole tag, algorithm, variant, threads). A tag is "[Serial NAME]", or "[Parallel NAME]" with
    "(engine, n threads)" behind the name, in brackets at the line's start."""
    inside = F.when(text.startswith("[") & text.contains("]"), F.substring_index(F.substr(text, F.lit(2)), "]", 1))
    head, detail = words(F.substring_index(inside, "(", 1)), F.when(inside.contains("("), F.substring_index(F.substring_index(inside, "(", -1), ")", 1))
    mode, name = F.get(head, 0), F.get(head, 1)
    engine, count = F.trim(F.substring_index(detail, ",", 1)), words(F.substring_index(detail, ",", -1))
    threads = F.get(count, 0).try_cast("int")
    whole = detail.isNull() | (engine.isin("OpenMP", "pthreads") & threads.isNotNull() & (F.get(count, 1) == "threads") & inside.endswith(")"))
    good = mode.isin("Serial", "Parallel") & (F.size(head) == 2) & (F.translate(name, string.ascii_uppercase, "") == "") & whole
    variant = F.when(mode == "Serial", "serial").when(engine == "OpenMP", "omp").otherwise("pthreads")
    return F.coalesce(good, F.lit(False)), F.lower(name), variant, F.coalesce(threads, F.lit(1))


def parse_strict(lines: DataFrame) -> DataFrame:
    """file, block and a benchmark row for every block of a known algorithm; metrics that a block lacks are 0."""
    text = F.trim("text")
    is_tag = text.startswith("[") & text.endswith("]")
    label = F.lit(None).cast("string")
    for name in METRICS:
        label = F.when(text.startswith(name), name).otherwise(label)
    label = F.when(~is_tag, label)
    ends = ~is_tag & label.isNull() & (text != "") & ~F.substr("text", F.lit(1), F.lit(1)).isin(" ", "\t")
    rows = _running(lines, block=is_tag, end=ends).where("block is not null and (end is null or end < block)").withColumn("label", label)
    value = scalar.number_after_colon(F.col("text"))
    tag = F.max(F.when(F.col("line") == F.col("block"), F.substring(text, F.lit(2), F.length(text) - 2))).alias("tag")
    found = rows.groupBy("file", "block").agg(tag, *(F.coalesce(F.max_by(value, F.when(F.col("label") == name, F.col("line"))), F.lit(0.0)).alias(c) for name, c in METRICS.items()))
    algorithm, variant, threads = classified(F.col("tag"))
    return found.select("file", "block", algorithm.alias("algorithm"), variant.alias("variant"), threads.alias("n_threads"), *METRICS.values()).where("algorithm <> 'unknown'")


def parse_loose(lines: DataFrame, framework: str = "ours", notes: str = "parsed from a log") -> DataFrame:
    """file, block and a harness row for every block whose tag has the whole form; metrics that a block lacks are 0."""
    rows = _running(lines, block=tag_parts(F.col("text"))[0]).where("block is not null")
    said = {"train_ms": "Training time", "infer_ms": "Inference time", "acc": "Accuracy", "prec": "Precision", "rec": "Recall", "f1": "F1 Score"}
    label, value = reading(F.col("text"))
    first, unit = F.get(words(value), 0).try_cast("double"), F.get(words(value), 1)
    indented = F.substr("text", F.lit(1), F.lit(1)).isin(" ", "\t")
    number = {c: F.when(indented & (label == name) & (unit == "ms" if c.endswith("_ms") else F.lit(True)), first) for c, name in said.items()}
    last = lambda c: F.max_by(number[c], F.when(number[c].isNotNull(), F.col("line")))
    tag = F.max(F.when(F.col("line") == F.col("block"), F.col("text"))).alias("tag")
    found = rows.groupBy("file", "block").agg(tag, *(F.round(F.coalesce(last(c), F.lit(0.0)), 2 if c.endswith("_ms") else 4).alias(c) for c in said))
    _, algorithm, variant, threads = tag_parts(F.col("tag"))
    return found.select("file", "block", algorithm.alias("algorithm"), F.lit(framework).alias("framework"), variant.alias("variant"), threads.alias("n_threads"), *said, F.lit(notes).alias("notes"))
