"""Token-id shards: every document is one zstandard frame under a dictionary shared by all shards.

Shard file: ``MAGIC``, the 32-byte SHA-256 of the dictionary (zeros: none), one byte with the width of an id (2 or 4
bytes, little-endian unsigned), the frames in ascending doc_id order, an index of ``<qQIIB`` rows (doc_id, place of the
frame, its bytes, ids, whether there is a doc_id), and a footer ``<QI`` (place and rows of the index) before ``MAGIC`` again. A
shard is read by its footer and index alone; a document takes one seek and one small decompression (``read_document``). A
shard has its name only when it is whole: a task that fails leaves no footer and no such file.

Cases: a null text counts as empty, so the document holds the end id alone; a null doc_id sorts first and is marked so in the
index; rows that repeat a doc_id are all kept, ordered by their bytes; where too little text is there to train a dictionary,
frames have none and the file says so; an empty table gives no shard and no rows; very long texts are frames like any other;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common
from orrery.llm.tokens import default_tokenizer, encoder, forget

MAGIC = b"IDSHARD2"
HEADER = len(MAGIC) + 33
_FOOT = "<QI"
_ROW = np.dtype([("doc_id", "<i8"), ("place", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("known", "u1")])
SHARDS = "shard int, path string, documents long, n_tokens long, dict_sha256 string"


def train_dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A zstandard dictionary trained on serialized id arrays; empty where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def sample_ids(docs: DataFrame, tokenizer: str, width: int, rows: int, chars: int) -> list[bytes]:
    """Serialized ids of a bounded sample: of the documents of the smallest hashes of their doc_id, among all rows, at most
    ``rows`` texts of at most ``chars`` characters. Hashes thin the table to about 2 * rows documents before it is ordered."""
    n = docs.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)
    some = docs.withColumn("h", place).where((F.col("h") <= int(min(1.0, 2 * rows / max(n, 1)) * 2**31)) & (F.length("text") > 0) & (F.length("text") <= chars))
    texts = [r[0] for r in some.select("text", "h").orderBy("h", "text").limit(rows).collect()]
    return [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in encoder(tokenizer).encode(texts)]


def width_of(tokenizer: str, end_id: int, width: int | None = None) -> int:
    """Bytes of an id: ``width``, or (None) the least that holds the tokenizer's ids and ``end_id``; raises where they don't fit."""
    most = max([end_id, *encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values()])
    width = width or (2 if most < 1 << 16 else 4)
    if width not in (2, 4) or end_id < 0 or most >= 1 << 8 * width:
        raise ValueError(f"ids up to {most} (end id {end_id}) don't fit {width} bytes")
    return width


def write_shards(
    docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 2, width: int | None = None, level: int = 3,
    shards: int | None = None, sample_rows: int = 1000, sample_chars: int = 20_000,
) -> DataFrame:
    """Writes the shards under ``path`` and returns a row for each: shard (their order), path, documents, n_tokens, dict_sha256.

    The dictionary is fitted on a bounded sample (``sample_rows`` texts of up to ``sample_chars``, by hash of doc_id from all rows); every
    document is written. Without a ``width``, ids have 2 bytes where all of them fit, else 4. Only compressed frames are
    shuffled, once, to ranges of doc_id.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    common.text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = width_of(tokenizer, end_id, width)
    data = train_dictionary(sample_ids(docs, tokenizer, width, sample_rows, sample_chars))
    sha = hashlib.sha256(data).digest() if data else bytes(32)
    shards = shards or max(1, docs.rdd.getNumPartitions())
    cuts = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], 100_000)).first()[0] or []
    bounds = np.unique(np.asarray(cuts if shards > 1 else [], dtype=np.int64))

    @common.tidy
    def frames(batches):
        import zstandard

        enc = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_content_size=True)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column(0), part.column(1).to_pylist()
                raw = [np.frombuffer(x + end, "<u4").astype(f"<u{width}") for x in enc.encode(texts)]
                keys = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.searchsorted(bounds, keys, side="left").astype(np.int32)), pa.array([len(x) for x in raw], pa.int64()), pa.array([pack.compress(x.tobytes()) for x in raw], pa.binary())],
                    names=["doc_id", "shard", "n_tokens", "frame"],
                )

    @common.tidy
    def store(batches):
        forget()
        fs, base = common.open_fs(path)
        out, name, place, rows, shard = None, None, 0, [], None

        def close():
            index = np.array(rows, _ROW)
            out.write(index.tobytes() + struct.pack(_FOOT, place, len(rows)) + MAGIC)
            out.close()
            fs.move(f"{name}.part", name)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x]) for x in (name, len(rows), int(index["ids"].sum(dtype=np.int64)), sha.hex()))], names=[c.split()[0] for c in SHARDS.split(", ")])

        try:
            for batch in batches:
                for doc, number, tokens, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if number != shard:
                        if out is not None:
                            yield close()
                        shard, name = number, f"{base}/{number:06d}-{uuid.uuid4().hex}.ids"
                        fs.create_dir(base, recursive=True)
                        out, place, rows = fs.open_output_stream(f"{name}.part"), HEADER, []
                        out.write(MAGIC + sha + bytes([width]))
                    out.write(body)
                    rows.append((doc or 0, place, len(body), tokens, doc is not None))
                    place += len(body)
            if out is not None:
                yield close()
        finally:
            if out is not None and not out.closed:  # cut short: no index, no name
                out.close()
                fs.delete_file(f"{name}.part")

    kept = docs.mapInArrow(frames, "doc_id long, shard int, n_tokens long, frame binary")
    dealt = kept.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", "frame")
    written = common.written(dealt.mapInArrow(store, SHARDS), "ids-shards")
    fs, base = common.open_fs(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary-{sha.hex()}.zdict") as f:
        f.write(data)
    return written


class Shard:
    """An open shard: its index, from the file's own footer, and its documents' ids."""

    def __init__(self, fs, path: str, dictionaries: str):
        import zstandard

        self.file = fs.open_input_file(path)
        size, tail = self.file.size(), struct.calcsize(_FOOT) + len(MAGIC)
        head, foot = self.file.read_at(HEADER, 0), self.file.read_at(tail, max(0, size - tail))
        if size < HEADER + tail or head[: len(MAGIC)] != MAGIC or foot[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no whole shard")
        place, rows = struct.unpack(_FOOT, foot[: -len(MAGIC)])
        self.index = np.frombuffer(self.file.read_at(rows * _ROW.itemsize, place), _ROW)
        sha, self.width = head[len(MAGIC) : len(MAGIC) + 32], head[HEADER - 1]
        data = b""
        if sha != bytes(32):
            with fs.open_input_file(f"{dictionaries}/dictionary-{sha.hex()}.zdict") as f:
                data = f.read()
            if hashlib.sha256(data).digest() != sha:
                raise ValueError(f"{path} was written with another dictionary")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(data))

    def ids(self, row: int) -> bytes:
        """Ids of the row-th document as unsigned 32-bit integers."""
        at = self.index[row]
        raw = self.unpack.decompress(self.file.read_at(int(at["bytes"]), int(at["place"])))
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()

    def rows_of(self, doc_id: int | None) -> np.ndarray:
        """The rows that hold a doc_id; the index is in the order of doc_ids, null first."""
        first = len(self.index) - int(self.index["known"].sum())
        if doc_id is None:
            return np.arange(first)
        ids = self.index["doc_id"][first:]
        return np.arange(*(first + np.searchsorted(ids, doc_id, side=s) for s in ("left", "right")))


def read_document(shard: str, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document (of all that share its doc_id) of one shard file; ``path``: where the shards were written."""
    fs, base = common.open_fs(path)
    opened = Shard(fs, shard, base)
    try:
        return [np.frombuffer(opened.ids(int(r)), "<u4") for r in opened.rows_of(doc_id)]
    finally:
        opened.file.close()


def read_shards(shards: DataFrame, path: str) -> DataFrame:
    """Reads every document of the shards back, by the files' own indexes: doc_id, start (ids of all documents before it),
    n_tokens, ids binary."""
    before, starts = 0, {}
    for r in sorted(shards.select("shard", "n_tokens").collect()):  # a row a shard
        starts[r["shard"]] = before
        before += r["n_tokens"]

    @common.tidy
    def read(batches):
        fs, base = common.open_fs(path)
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                opened = Shard(fs, name, base)
                n = opened.index["ids"].astype(np.int64)
                start = starts[number] + np.cumsum(n) - n
                for at in range(0, len(n), 512):
                    rows = slice(at, at + 512)
                    some = opened.index[rows]
                    ids = pa.array([opened.ids(i) for i in range(at, min(at + 512, len(n)))], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(some["doc_id"].astype(np.int64), mask=some["known"] == 0), pa.array(start[rows]), pa.array(n[rows]), ids], names=["doc_id", "start", "n_tokens", "ids"])
                opened.file.close()

    dealt = shards.select("shard", "path").repartition(common.row_parallelism(shards.sparkSession))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-shards")
    shards = write_shards(common.table(spark, sf_dir, "documents"), path)
    return read_shards(shards, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
