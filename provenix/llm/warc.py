"""WARC archives: one gzip member per record, written and read in parallel.

Writing: which record of equal payloads is kept is settled by an aggregate before anything is written; then every task
writes its records to archives in a shared folder, under names made from the task's own number and completed by a rename, so
a task that runs twice leaves the same files. Reading: Spark deals the archives out; each is read from front to back,
decompressed in steps, framed by content-length, and its digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.llm.common import run_folder

LEAST = 1000  # bytes of payload from which equal payloads are written once
ARCHIVE = 32 << 20  # compressed bytes after which a task begins its next archive
STEP = 1 << 16
DATE = "2000-01-01T00:00:00Z"  # archives of the same rows are the same bytes
OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, error string"
MAGIC = b"\x1f\x8b\x08"  # fixed value: how a gzip member begins


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds payload (binary), digest (SHA-1, hex) and original: the largest page_id of equal payloads of at least ``least`` bytes."""
    read = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = read.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return read.join(first, ["digest", "size"], "left")


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _b32(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has headers only and names the record it repeats."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    uid = lambda key: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(key))}>"
    fields = [
        ("WARC-Record-ID", uid(f"{page_id}|{target}")), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _b32(hashlib.sha1(payload).digest())), ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())), ("X-Payload-Length", str(len(payload))),
    ]
    fields += [("WARC-Target-URI", target)] if url is not None else []
    fields += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", uid(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record("revisit" if revisit else "response", fields, block)


def write(rows: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """rows(page_id, url, payload, original) -> (file, records, bytes), one row for each archive written below ``folder``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        task, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        done, out, size, count = [], None, 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            name = f"{root}/part-{task:06d}-{len(done):05d}.warc.gz"
            store.move(temp, name)
            done.append((name, count, size))
            out = None

        for batch in batches:
            for page_id, url, payload, original in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    temp = f"{root}/_{task:06d}-{len(done):05d}-{mark}"
                    out, size, count = store.open_output_stream(temp, compression=None), 0, 0
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = press.compress(record_bytes(page_id, url, payload, original if original != page_id else None)) + press.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return rows.select("page_id", "url", "payload", "original").mapInArrow(run, "file string, records long, bytes long")


def members(stream: Iterable[bytes]) -> Iterator[tuple[bytes | None, str | None]]:
    """The uncompressed content of each gzip member of a file, read in steps. In place of what can't be decompressed stands (None, why), and reading goes on
    where the next member begins."""
    unpack, got, lost, rest = None, [], False, b""
    for chunk in stream:
        chunk, rest = rest + chunk, b""
        while chunk:
            if lost:
                at = chunk.find(MAGIC)
                if at < 0:
                    rest = chunk[-2:]  # a beginning may be cut in two
                    break
                chunk, lost = chunk[at:], False
            unpack = unpack or zlib.decompressobj(31)
            try:
                got.append(unpack.decompress(chunk))
            except zlib.error as e:
                yield None, str(e)
                unpack, got, lost, chunk = None, [], True, chunk[1:]
                continue
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(got), None
                unpack, got = None, []
    if unpack is not None:
        yield None, "the archive ends inside a gzip member"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; the block is exactly content-length bytes, then two line ends."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("content-length does not frame the record")
    return fields, rest[:n]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Reads every archive below folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to, verified, error.

    A record that can't be decompressed, is not framed by its content-length or has a digest that does not match is one row with verified false and
    the error; it stops neither the records after it nor the job. ``where("not verified")`` is the table of what was refused.
    """

    def row(record: bytes | None, why: str | None) -> tuple:
        try:
            if record is None:
                raise ValueError(why)
            f, block = parse(record)
            body = block.partition(b"\r\n\r\n")[2]
            digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:"))
            revisit = f["warc-type"] == "revisit"
            whole = lambda k: int(f[k]) if k in f else None
            got = (whole("x-page-id"), f.get("warc-target-uri"), int(f["x-payload-length"]) if revisit else len(body), digest.hex(), f["warc-type"], whole("x-refers-to-page-id"))
            ok = _b32(hashlib.sha1(block).digest()) == f["warc-block-digest"] and (revisit or hashlib.sha1(body).digest() == digest)
            return (*got, ok, None if ok else "a digest does not match")
        except (ValueError, KeyError) as e:
            return (None,) * 6 + (False, f"{type(e).__name__}: {e}"[:200])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                view, rows = memoryview(content.as_buffer()), []
                for record, why in members(bytes(view[i : i + STEP]) for i in range(0, len(view), STEP)):
                    rows.append(row(record, why))
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", "error"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content").mapInArrow(run, OUT)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) to archives and reads them back, one row for each row of pages.

    Of equal payloads the largest page_id is the response; rows that share that id are all responses, and a null id never is the
    largest unless all are null. A null html is an empty payload. An empty table writes no archive and gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or run_folder(spark, "warc")
    written = write(with_originals(pages), folder).agg(F.sum("records").alias("n")).first()["n"]
    if not written:
        return spark.createDataFrame([], OUT)
    return read(spark, folder)


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b) n, sha1(b) s from p),
o as (select s, n, max(page_id) first, count(*) c from d where n >= 1000 group by all)
select d.page_id, cast(d.n as bigint) payload_bytes, d.s payload_digest,
  case when c > 1 and d.page_id <> first then 'revisit' else 'response' end record_type,
  case when c > 1 and d.page_id <> first then first end refers_to
from d left join o on d.s = o.s and d.n = o.n
"""
