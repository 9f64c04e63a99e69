"""WARC archives: writing captures, reading records, and assembling transactions through concurrent-to identifiers.

Every capture is three records, each its own gzip member: the response (or, where an equal payload was captured under a
smaller id, a revisit without body), its request, and metadata; request and metadata name the capture's record in
WARC-Concurrent-To. The reader parses whatever record order the files have, keeps every value of a header field that repeats,
and joins the three kinds by these identifiers, on whichever side they stand; all requests of a capture are kept.

Cases: null html is an empty payload; a null url is written as an empty target; a null page_id sorts after all others and
never is referred to by number; rows that repeat page_id and payload are captures each, the first of them the response;
payloads below ``least`` bytes are responses each; captures without request or metadata have null or an empty array; a record
that names several captures is part of each, one that names none, and that none names, of no transaction; an empty table gives
no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common

DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, target string, date string, refers_to string, payload_digest string, payload_bytes long, page_id long, block binary, concurrent array<string>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in lines) + "\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 4, mtime=0)


def capture_records(page_id: int | None, row: int, url: str | None, payload: bytes, first: int | None) -> list[bytes]:
    """The gzip members of one capture; ``first``: row of the response that it revisits."""
    name = lambda kind, n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind}/{n}')}>"
    target = ("WARC-Target-URI", " ".join((url or "").split()))
    mine = name("capture", row)
    fields = [("WARC-Record-ID", mine), target, ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        main = record("response", [*fields, ("Content-Type", "application/http;msgtype=response")], http + payload)
    else:
        fields += [("WARC-Refers-To", name("capture", first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        main = record("revisit", [*fields, ("Content-Type", "application/http;msgtype=response")], http)
    ask = record("request", [("WARC-Record-ID", name("request", row)), target, ("WARC-Concurrent-To", mine), ("Content-Type", "application/http;msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    about = "" if page_id is None else f"page: {page_id}\r\n"
    meta = record("metadata", [("WARC-Record-ID", name("metadata", row)), target, ("WARC-Concurrent-To", mine), ("Content-Type", "application/warc-fields")], about.encode())
    return [main, ask, meta]


def write_archives(pages: DataFrame, path: str, *, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under ``path``; the table of files (path) that count, written."""
    common.text_batches(pages.sparkSession)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("long", F.octet_length("payload") >= least)
    rows = common.written(rows, "pages")  # so that a row keeps its number whoever reads it
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = rows.where("long").groupBy("sha").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = common.written(first.select("sha", F.col("f.row").alias("first_row"), "n"), "first-captures")
    keyed = rows.withColumn("sha", F.when(F.col("long"), F.col("sha")))
    dealt = common.skew_join(keyed, first.select("sha", "first_row"), "sha", "left", counts=first).select("page_id", "row", "url", "payload", "first_row")

    @common.tidy
    def store(batches):
        fs, base = common.open_fs(path)
        name = out = None
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for page, n, url, payload, fr in zip(*(batch.slice(at, 64).column(i).to_pylist() for i in range(5))):
                        if out is None:
                            fs.create_dir(base, recursive=True)
                            name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                            out = fs.open_output_stream(f"{name}.part", compression=None)
                        for r in capture_records(page, n, url, payload, None if fr is None or fr == n else fr):
                            out.write(r)
        finally:
            if out is not None:
                out.close()
        if name:  # only a whole archive gets its name
            fs.move(f"{name}.part", name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    return common.written(dealt.mapInArrow(store, "path string"), "warc-files")


def parse(stream):
    """(fields, block) of every record of an open archive, one at a time; a field has all its values."""
    with gzip.open(stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            fields = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                key, _, value = line.partition(b":")
                fields.setdefault(key.strip().decode().lower(), []).append(value.strip().decode("utf-8", "surrogatepass"))
            yield fields, f.read(int(fields["content-length"][0]))


def read_records(files: DataFrame, path: str, *, blocks: bool = False) -> DataFrame:
    """One row per record; digest and size of a response are those of the payload as read, checked against its field."""

    @common.tidy
    def read(batches):
        fs, _ = common.open_fs(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for every, block in parse(stream):
                        f = {name: values[0] for name, values in every.items()}
                        kind, size, page, told = f["warc-type"], None, None, f.get("warc-payload-digest", "").rpartition(":")[2] or None
                        head, _, body = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            size = len(body)
                            if digest(body) != told:
                                raise ValueError(f"{f['warc-record-id']}: its payload isn't the one that was written")
                        elif kind == "revisit":
                            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        elif kind == "metadata":
                            page = next((int(x[5:]) for x in block.split(b"\r\n") if x.startswith(b"page:")), None)
                        keep = block if blocks or kind == "metadata" else None
                        rows.append((f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-target-uri"), f["warc-date"], f.get("warc-refers-to"), told, size, page, keep, every.get("warc-concurrent-to", [])))
                        held += len(keep or b"")
                        if len(rows) == 2048 or held > 8_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path").repartition(common.row_parallelism(files.sparkSession)).mapInArrow(read, RECORD)


def _batch(rows):
    kinds = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.binary(), pa.list_(pa.string())]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture, request (the first one), requests and metadata (arrays of all); joined by the
    concurrent-to identifiers of either side."""
    records = common.written(records, "records")
    body = F.struct("record_id", "type", "concurrent_to", "target", "date", "refers_to", "payload_digest", "payload_bytes", "page_id", "block")
    main, ask, meta = F.col("type").isin("response", "revisit"), F.col("type") == "request", F.col("type") == "metadata"
    parts = records.withColumn("key", F.explode(F.when(main, F.array("record_id")).otherwise(F.array_distinct("concurrent"))))
    naming = records.where(main & (F.size("concurrent") > 0)).select(F.col("record_id").alias("key"), F.explode(F.array_distinct("concurrent")).alias("record_id"))
    if not naming.isEmpty():
        parts = parts.unionByName(records.where(~main).join(naming, "record_id"))
    every = lambda kind: F.array_distinct(F.sort_array(F.collect_list(F.when(kind, body))))  # noqa: E731  a record named from both sides is there once
    nested = parts.groupBy(F.col("key").alias("capture_id")).agg(F.max(F.when(main, body)).alias("capture"), every(ask).alias("requests"), every(meta).alias("metadata"))
    return nested.where("capture is not null").select("capture_id", "capture", F.get("requests", 0).alias("request"), "requests", "metadata")


def captures(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page of the response whose record id a revisit names) of
    every transaction. Raises where a revisit's digest isn't that of the response."""
    rows = found.select(
        F.col("metadata")[0]["page_id"].alias("page_id"), "capture_id", F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("refers"),
    )
    rows = common.written(rows, "captures")
    told = rows.where("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("its_digest"))
    both = common.skew_join(rows, told, "refers", "left")
    same = F.when(F.col("refers").isNull() | (F.col("payload_digest") == F.col("its_digest")), F.col("payload_digest"))
    same = same.otherwise(F.raise_error(F.concat(F.lit("a revisit names no response of its payload: "), "capture_id")))
    return both.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


def op1_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    return captures(transactions(read_records(write_archives(common.table(spark, sf_dir, "pages"), path), path)))


#: SQL has no base32: five bits at a time of the SHA-1 digest's hex form, of which four digits of two make eight letters of five.
_BITS = "list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), lambda a, b: a || b)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, h, {_BITS} AS bits FROM p),
d AS (SELECT page_id, payload_bytes, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) * (1 << (5 - j)))) AS INTEGER) + 1, 1)), lambda a, b: a || b) AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS f FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM d
"""
