"""Toxicity by subword bags: the embeddings of a document's character n-grams averaged into a linear softmax.

Each word is a bag of hashed character n-grams (with word marks) and of itself; a document is the average of its words'
bags. Embeddings and softmax are trained jointly in numpy (full batches, Adam) on a bounded sample of labelled rows, so a
misspelling that training never saw shares most of its n-grams with the word that it stands for. Since all is linear up to
the softmax, a word's share of the logit is one number, kept by the scoring workers in a bounded dictionary.

Cases: a null or empty text, or one without letters or digits, has an empty bag: its score is the softmax of the bias; a row
without label isn't trained on; contradictory labels of a doc_id are averaged, ties count as toxic; without labelled rows of
both classes every score is the share of toxic labels (0 without any); rows that repeat a doc_id are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common

BUCKETS, DIM, NGRAMS = 1 << 17, 8, (3, 4, 5)
#: Bounds of the training sample: rows of each class, characters of a text.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
STEPS, RATE, DECAY, SCALE = 200, 0.02, 1e-3, 300.0
#: Subword buckets with embeddings, and documents of the sample that such a bucket is in.
FEATURES, LEAST = 4096, 5
CUT = 0.7
_WORD = re.compile(r"\w+")
_MAX_WORDS = 1_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(word: str) -> list[int]:
    """Buckets of the word and its n-grams; a very long word gives its n-grams like any other."""
    marked = f"<{word}>"
    if marked.isascii():  # then slices of bytes are those of characters
        raw = marked.encode()
        grams = {raw, *(raw[i : i + n] for n in NGRAMS for i in range(len(raw) - n + 1))}
    else:
        grams = {marked, *(marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1))}
        grams = {g.encode("utf-8", "surrogatepass") for g in grams}
    return [crc32(g) % BUCKETS for g in grams]


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(share of each bucket in the toxic logit, bias): the buckets' embeddings times the difference of softmax weights.

    Only the FEATURES buckets whose presence tells most about the label (chi-square, in LEAST documents at least) have
    embeddings, the others are zero; so rare n-grams can't stand for single documents.
    """
    y = np.asarray(labels, float)
    seen: dict[str, np.ndarray] = {}
    bags = []
    for text in texts:
        count: dict[str, int] = {}
        for w in words_of(text):
            count[w] = count.get(w, 0) + 1
        for w in count:
            if w not in seen:
                seen[w] = np.array(subwords(w), np.int64)
        own = [seen[w] for w in count] or [np.zeros(0, np.int64)]
        share = np.repeat([c / max(len(seen[w]), 1) for w, c in count.items()], [len(seen[w]) for w in count])
        used, at = np.unique(np.concatenate(own), return_inverse=True)
        bags.append((used.astype(np.int32), (np.bincount(at, share, len(used)) / max(sum(count.values()), 1)).astype(np.float32)))
    with_, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (used, _), t in zip(bags, y):
        with_[used] += 1
        toxic[used] += t
    n, k = len(y), y.sum()
    gain = n * (toxic * n - with_ * k) ** 2 / np.maximum(with_ * (n - with_) * k * (n - k), 1e-9)
    chosen = np.argsort(np.where(with_ >= LEAST, -gain, 1), kind="stable")[:FEATURES]
    where = np.full(BUCKETS, -1)
    where[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    for row, (used, share) in zip(x, bags):
        at = where[used]
        row[at[at >= 0]] = share[at >= 0]
    scale = SCALE
    x *= scale
    draw = np.random.default_rng(seed)
    p = {"e": draw.normal(0, 0.01, (len(chosen), DIM)).astype(np.float32), "w": draw.normal(0, 1, (DIM, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = np.where(y == 1, 0.5 / k, 0.5 / (n - k))
    for step in range(1, STEPS + 1):
        h = x @ p["e"]
        z = h @ p["w"] + p["b"]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        g = ((q - np.stack([1 - y, y], axis=1)) * weight[:, None]).astype(np.float32)
        grads = {"e": x.T @ (g @ p["w"].T) + DECAY * p["e"], "w": h.T @ g + DECAY * p["w"], "b": g.sum(axis=0)}
        for name, v in grads.items():
            m, s = moments[name]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    logit = np.zeros(BUCKETS)
    logit[chosen] = p["e"] @ (p["w"][:, 1] - p["w"][:, 0]) * scale
    return logit, float(p["b"][1] - p["b"][0])


class Scorer:
    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias, self.seen = logit.tolist(), bias, {}

    def score(self, text: str | None) -> float:
        words, seen = words_of(text), self.seen
        if len(seen) > _MAX_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            bag = subwords(w)
            seen[w] = sum(map(self.logit.__getitem__, bag)) / len(bag)
        z = self.bias + (sum(map(seen.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(common.crc32_of(doc_id) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, toxic), written: of each class the ``rows`` documents of the smallest hashes of their doc_id, held-out ones and
    texts that are empty or longer than ``chars`` left out.

    Only ids and labels are joined and ordered. A class of n documents is thinned by its hashes to about 2 * rows before it is
    ordered, so what the tasks send doesn't grow with the corpus; the at most 2 * rows chosen ids then fetch their texts.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    usable = docs.where((F.length("text") > 0) & (F.length("text") <= chars) & ~held_out(F.col("doc_id")))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    known = common.written(usable.select("doc_id").distinct().join(marks, "doc_id").select("doc_id", "toxic", place.alias("h")), "labelled")
    found = dict(known.groupBy("toxic").count().collect())
    parts = [known.where((F.col("toxic") == c) & (F.col("h") < int(min(1.0, 2 * rows / n) * 2**31))).orderBy("h", "doc_id").limit(rows) for c, n in sorted(found.items())]
    if not parts:
        return known.select(F.lit("").alias("text"), "toxic")
    chosen = common.written(functools.reduce(DataFrame.union, parts).select("doc_id", "toxic"), "chosen")
    texts = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return common.written(texts.select("text", "toxic"), "sample")


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Scorer:
    """The model of labelled documents outside the held-out fold: at most ``rows`` of each class of at most ``chars`` characters,
    those of the smallest hashes of their doc_id; of rows that share one, the least text."""
    some = sorted(tuple(r) for r in sample(docs, labels, rows, chars).collect())
    y = np.array([r[1] for r in some], float)
    if len(set(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Scorer(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    return Scorer(*train([r[0] for r in some], y))


def scores(docs: DataFrame, model: Scorer, *, cut: float = CUT, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; with ``keep`` the rows of docs that aren't predicted toxic, as they are."""
    common.text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((np.array(model.logit, np.float32), model.bias))  # BUCKETS * 4 bytes

    @common.tidy
    def judge(batches):
        scorer = Scorer(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = np.array([scorer.score(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()], float)
                if keep:
                    yield part.filter(pa.array(s < cut))
                else:
                    out = pa.array((s >= cut).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), out], names=["doc_id", "score", "predicted"])

    if keep:
        return docs.mapInArrow(judge, docs.schema)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, common.table(spark, sf_dir, "labels")))
