"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, packing; each stage works on what the one
before it kept. Every stage judges rows, not doc_ids: the two in the middle give each row a number of its own, so rows that share a
doc_id, or have none, are judged each."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common, decontaminate, minhash, packing, toxicity

ROW = "_pipeline_row"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model doesn't predict toxic."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, keep=True)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, written; a column of the number's name raises."""
    if ROW in docs.columns:
        raise ValueError(f"docs already have a column named {ROW}")
    return common.written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but the rows in gone, without their number. gone is written, so that its size is known: while the numbers are few
    enough to be broadcast, no text is shuffled."""
    return docs.join(common.written(gone, "gone"), ROW, "left_anti").drop(ROW)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id (null: last) of each near-duplicate group, and every row without words."""
    rows = numbered(docs)
    found = minhash.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), k=5, percent=80)
    found = common.written(found.select(F.col("doc_id").alias(ROW), "component_id"), "components-of-rows")
    # a group may hold a third of all rows: its rows but the root need no look at the others, and roots have keys of their own
    others, roots = found.where(F.col(ROW) != F.col("component_id")), found.where(F.col(ROW) == F.col("component_id"))
    some = others.union(roots.join(others.select("component_id").distinct(), "component_id", "left_semi").select(ROW, "component_id"))
    members = common.written(some.join(rows.select(ROW, "doc_id"), ROW), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("f")).select(F.col(f"f.{ROW}").alias(ROW))
    return without(rows, members.select(ROW).join(first, ROW, "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows = numbered(docs)
    found = decontaminate.contamination(rows.select(F.col(ROW).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias(ROW)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens from the remaining documents."""
    return packing.pack_documents(docs)


#: What each stage's last call has made in the shared folder.
_made: dict[str, list[str]] = {}


def freed(name: str, before: str | None, stage):
    """stage, which first removes what the stage before it has made: its rows are written and nothing else reads that. What docs
    themselves still read stays."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.remove(_made.pop(before, []), docs)
        count = common.made_count()
        out = stage(spark, docs, sf_dir)
        _made[name] = common.made_since(count)
        return out

    return run_stage


_IN_ORDER = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]
STAGES = [(name, freed(name, before, stage)) for (name, stage), before in zip(_IN_ORDER, [None, *(n for n, _ in _IN_ORDER)])]
#: SQL has neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
