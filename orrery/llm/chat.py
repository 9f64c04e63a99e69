"""Reply trees: root-to-leaf paths by iterative self-joins, ranked by score, each chosen one formatted as a conversation.

Jump tables (the 2^i-th ancestor of every message) come from self-joins of the table before; the leaves then reach all
their ancestors from the highest table down to the lowest, so a path of n messages takes log n joins and each of its
messages is reached once. Only ids are joined; texts follow once, for chosen paths.

Format of a turn: TURN role TEXT text END. The control strings below inside a role or text get a backslash behind their first
character, and a backslash is doubled, so that the text can be read back and no text can open or close a turn. The loss mask is
``loss_spans``: code point ranges [start, end) of the (escaped) assistant texts.

Cases: null role or text counts as empty; a message whose parent is unknown or null is a root; messages on a cycle have no
leaf and raise; equal scores are ranked by the leaf's id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import common

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>"]
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\?)")
_PARSE = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


def paths(messages: DataFrame, rounds: int = 40) -> DataFrame:
    """leaf, id, up (steps from the leaf) for every message (id, parent) on every root-to-leaf path."""
    known = messages.select("id", "parent")
    up = known.join(known.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    tables = [common.written(up, "jump-0")]
    while not tables[-1].isEmpty():
        if len(tables) > rounds:
            raise ValueError("the replies hold a cycle")
        last = tables[-1]
        tables.append(common.written(last.toDF("id", "middle").join(last.toDF("middle", "parent"), "middle").select("id", "parent"), f"jump-{len(tables)}"))
    found = known.join(tables[0].select(F.col("parent").alias("id")), "id", "left_anti").select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for i in range(len(tables) - 2, -1, -1):
        more = found.join(tables[i], "id").select("leaf", F.col("parent").alias("id"), (F.col("up") + 2**i).alias("up"))
        found = common.written(found.union(more), "paths")
    return found


def conversations(messages: DataFrame, *, best: int = 1) -> DataFrame:
    """conv_id, leaf, branch (1: best score), score (mean of the path's), formatted, loss_spans for the ``best`` branches of
    each conversation; messages have conv_id, id (unique), parent, role, text, score."""
    steps = paths(messages)
    scored = steps.join(messages.select("id", "conv_id", "score"), "id")
    branch = scored.groupBy("leaf").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf"))
    chosen = branch.withColumn("branch", rank).where(F.col("branch") <= best)
    rows = steps.join(chosen, "leaf").join(messages.select("id", "role", "text"), "id")
    turns = rows.groupBy("conv_id", "leaf", "branch", "score").agg(F.sort_array(F.collect_list(F.struct("up", "role", "text")), asc=False).alias("turns"))

    def write(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [format_turns([(t["role"], t["text"]) for t in x]) for x in part.column(4).to_pylist()]
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array([f for f, _ in made], pa.string()), spans], names=["conv_id", "leaf", "branch", "score", "formatted", "loss_spans"])

    return turns.mapInArrow(write, "conv_id long, leaf long, branch int, score double, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """The columns of the query, all read back from the formatted conversations."""

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    turns = parse_turns(text)
                    loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                    told = "".join(f"{r}\n{t}\n" for r, t in turns)
                    rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each answers the one before it by turn (then by role and
    text); written, so that ids stay."""
    numbered = common.written(rows.withColumn("id", F.monotonically_increasing_id()), "messages")
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "id"))
    return numbered.select("conv_id", "id", before.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(conversations(common.written(chains(rows), "chains")))


def _escaped(x: str) -> str:
    x = rf"replace({x}, '\', '\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
