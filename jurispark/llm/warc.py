"""WARC archives as a chunked record table.

A record is written as rows (record_id, chunk, n_chunks, data, digest): its bytes in order, cut every chunk_bytes. The concatenated
data of a record is a WARC/1.1 record, so that all records one after another are an archive. The writer streams a payload
through one SHA-1 and gives each row the digest of the payload up to there; neither it nor the reader holds more than one chunk
and a header beside the row it is given. Records of one chunk are read where they lie; only longer ones are brought together by
record_id and read in chunk order.

Of the records with equal payloads of at least `min_bytes`, that with the largest page_id is the response and the others are revisits
that name it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurispark.llm.shared import cut, join_heavy, remove_at_end, shared_path, text_batches

CHUNK_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"

TABLE = "record_id string, chunk int, n_chunks int, data binary, digest string"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, intact boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_records(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(sha1, largest, copies, held): for each payload the largest page_id, its rows with that id, and all its rows. A null page_id never is the largest."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.sha1(_payload(html)).alias("sha1")).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    return cut(slim.groupBy("sha1").agg(F.max("page_id").alias("largest"), F.max_by("n", "page_id").alias("copies"), F.sum("n").alias("held")))


def _payload(html: str):
    return F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")


def _header(kind: str, record: str, uri: str | None, digest: str, http: bytes, length: int, response: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}"]
    if uri:
        lines.append(f"WARC-Target-URI: {''.join(uri.split())}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{response}:{digest}>"]
    lines.append(f"Content-Length: {len(http) + length}")
    return "\r\n".join(lines).encode() + END + http


def _write(chunk_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for part in parts:
            rows = []
            held = 0
            for page, uri, html, revisit, response, alone in zip(*(part.column(c) for c in ("page_id", "url", "html", "revisit", "response", "alone"))):
                page, revisit, response, row = page.as_py(), revisit.as_py(), response.as_py(), row + 1
                buffer = html.as_buffer() if html.is_valid else None
                payload = memoryview(buffer) if buffer is not None else memoryview(b"")
                sha = hashlib.sha1()
                for k in range(0, len(payload), chunk_bytes):
                    sha.update(payload[k : k + chunk_bytes])
                whole = base32(sha.digest())
                record = f"{RECORD}{'' if page is None else page}:{whole}" + ("" if alone.as_py() else f":{task}-{row}")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                body = memoryview(b"") if revisit else payload
                head = _header("revisit" if revisit else "response", record, uri.as_py(), whole, http, len(body), response)
                total = len(head) + len(body) + len(END)
                n, running, done = -(-total // chunk_bytes), hashlib.sha1(), 0
                for c in range(n):
                    low, high = c * chunk_bytes, min(total, (c + 1) * chunk_bytes)
                    a, b = (min(max(x - len(head), 0), len(body)) for x in (low, high))
                    running.update(body[a:b])
                    data = head[low:high] + bytes(body[a:b]) + END[max(0, low - len(head) - len(body)) : max(0, high - len(head) - len(body))]
                    rows.append((record, c, n, data, base32(running.digest())))
                    held += len(data)
                    done += b - a
                    if held >= 16 * chunk_bytes:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["record_id", "chunk", "n_chunks", "data", "digest"])


def write(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Writes the archives of pages as a record table and returns its path, by default a new one in the shared folder, which goes when the application ends.

    A null html is an empty payload; other columns are left out; an empty table gives a table without records. Every row is a record of
    its own, also where rows repeat or have no page_id: an id is the page_id and the payload's digest, and for all but a response
    whose page_id no other row of its payload has, the writing task and a row number. Rows of one payload that all have the largest
    page_id, or all have none, are all responses; a revisit of repeated responses names what their ids begin with.
    """
    text_batches(pages.sparkSession)
    if path is None:
        path = shared_path(pages.sparkSession, "warc")
        remove_at_end(pages.sparkSession, path)
    planned = plan_records(pages, page_id, html)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"), F.sha1(_payload(html)).alias("sha1"))
    total = planned.agg(F.sum("held")).first()[0] or 1
    joined = join_heavy(rows, planned, ["sha1"], "held", total, F.monotonically_increasing_id())
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")) & (F.octet_length(_payload("html")) >= min_bytes)
    alone = F.col("page_id").eqNullSafe(F.col("largest")) & F.col("page_id").isNotNull() & (F.col("copies") == 1)
    joined = joined.select("page_id", "url", "html", revisit.alias("revisit"), F.col("largest").alias("response"), alone.alias("alone"))
    joined.mapInArrow(_write(chunk_bytes), TABLE).write.parquet(path)
    return path


class Reader:
    """Takes the chunks of records in order and gives a row for each record that ends; the header is all it keeps."""

    def __init__(self):
        self.record = None

    def feed(self, record: str, chunk: int, n: int, data: memoryview) -> tuple | None:
        if chunk == 0:
            self.record, self.head, self.http, self.sha, self.left, self.size = record, b"", None, hashlib.sha1(), None, 0
        if record != self.record:
            return None
        if self.http is None:
            self.head += bytes(data)
            warc, found, rest = self.head.partition(END)
            http, ended, body = rest.partition(END)
            if found and ended:
                self.fields = _fields(warc)
                self.left = int(self.fields["content-length"]) - len(http) - len(END)
                self.http, self.head, data = _fields(http), b"", memoryview(body)
            else:
                data = memoryview(b"")
        if self.http is not None:
            part = data[: max(0, self.left - self.size)]
            self.sha.update(part)
            self.size += len(part)
        return self.row() if chunk == n - 1 and self.http is not None else None

    def row(self) -> tuple:
        kind, digest = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:")
        page, refers = _page(self.fields["warc-record-id"]), _page(self.fields.get("warc-refers-to", ""))
        if kind == "revisit":
            return page, int(self.http["content-length"]), digest, kind, refers, self.fields.get("warc-target-uri"), self.size == 0
        return page, self.size, base32(self.sha.digest()), kind, None, self.fields.get("warc-target-uri"), self.size == self.left and base32(self.sha.digest()) == digest


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(uri: str) -> int | None:
    found = uri.strip("<>").removeprefix(RECORD).partition(":")[0]
    return int(found) if found.lstrip("-").isdigit() else None


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for part in parts:
        rows = []
        for record, chunk, n, data in zip(part.column("record_id").to_pylist(), part.column("chunk").to_pylist(), part.column("n_chunks").to_pylist(), part.column("data")):
            row = reader.feed(record, chunk, n, memoryview(data.as_buffer()))
            if row:
                rows.append(row)
        cols = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "intact"])


def read(records: DataFrame) -> DataFrame:
    """One row a record of a record table: what its bytes say, with the payload's digest computed anew from the chunks.

    Records whose bytes do not match their header are given with intact false. Each record's id has to be its own, as `write` makes it;
    an empty table gives no rows.
    """
    records = records.select("record_id", "chunk", "n_chunks", "data")
    short = records.where("n_chunks = 1").mapInArrow(_read, PAGES)
    long = records.where("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk").mapInArrow(_read, PAGES)
    return short.unionByName(long)
