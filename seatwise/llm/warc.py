"""WARC archives: a writer with revisit records, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path

CHUNK = 1 << 18
#: Bytes after which a writer starts the next file.
ROLL_BYTES = 256 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """A URL as it may stand on one header line."""
    return "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header only, which still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_uri(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {_REVISIT}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, refers_to, revisit in zip(*(batch.column(i) for i in range(6)), strict=True):
                if out is None:  # a new name for each attempt: a task that is run again never meets its own leavings
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                raw = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py(), revisit.as_py())
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= roll:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", count, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return write


class Damaged(ValueError):
    """An archive breaks the format, or a digest doesn't match."""


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The plain bytes of each gzip member, piece by piece as they are decompressed."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        unpack = zlib.decompressobj(31)

        def pieces(unpack=unpack):
            nonlocal rest
            while not unpack.eof:
                data = unpack.unconsumed_tail or rest or stream.read(CHUNK)
                rest = b""
                if not data:
                    raise Damaged("the archive ends inside a member")
                if piece := unpack.decompress(data, CHUNK):
                    yield piece
            rest = unpack.unused_data

        yield pieces()


def read_records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Header fields of the record and of its HTTP block (names in lower case), and the payload.

    Sequential: one member at a time, never more than one record in memory. Frames by Content-Length and verifies the
    block digest, and of a response also the payload digest; raises Damaged otherwise.
    """
    for member in _members(stream):
        buffer = bytearray()
        for piece in member:
            buffer += piece
        head, mark, rest = bytes(buffer).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not mark or not first.startswith("WARC/"):
            raise Damaged("a member doesn't start with a record header")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        length = int(fields["content-length"])
        block, tail = rest[:length], rest[length:]
        if len(block) != length or tail != b"\r\n\r\n":
            raise Damaged("Content-Length doesn't match the member")
        if fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
            raise Damaged("block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        inner = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
        if fields["warc-type"] == "response" and (len(payload) != int(inner["content-length"]) or fields["warc-payload-digest"] != f"sha1:{digest_of(payload)}"):
            raise Damaged("payload digest")
        yield fields, inner, payload


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * with_payload]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for fields, inner, payload in read_records(stream):
                        kind = fields["warc-type"]
                        row = (_page(fields["warc-record-id"]), fields["warc-target-uri"], int(inner["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None)
                        rows.append((*row, payload.decode() if kind == "response" else None) if with_payload else row)
                        held += 200 + len(payload) * with_payload
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return read


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as .warc.gz files below folder; returns the files: path, records, bytes.

    Of payloads of at least min_revisit_bytes that are equal, the smallest page_id is stored as a response and the others
    as revisits of it; smaller payloads are all responses. Null html is an empty payload, a null url is urn:none, a null
    page_id sorts first. Rows that repeat the smallest page_id with its payload are all responses. An empty table
    writes nothing. The first page of each payload comes from an aggregation with partial sums, and is joined by payload,
    which Spark may split where one payload has very many pages. folder is any URI that pyarrow opens on the executors.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    sums = cut(pages.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")), "payloads")
    firsts = cut(sums.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.min(F.struct("page_id")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    known = sums.join(firsts, "digest", "left").select("page_id", "digest", F.col("first.page_id").alias("first"), (F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).alias("revisit"))
    # A page_id may repeat with other payloads: one map entry for each payload of the page.
    known = known.dropDuplicates(["page_id", "digest"])
    rows = pages.join(known, pages.page_id.eqNullSafe(known.page_id) & (pages.digest == known.digest)).select(pages.page_id, "url", "html", pages.digest, F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")
    return cut(rows.mapInArrow(_writer(folder, roll_bytes), "path string, records long, bytes long"), "archives")


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives (column path), read one member after another and verified.

    Columns page_id, url, payload_bytes (of the full payload, revisits too), payload_digest, record_type, refers_to and,
    if asked for, payload. Files are dealt out to tasks; a file is read by one task, with one record in memory.
    """
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    paths = archives.select("path").distinct()
    return paths.repartition(max(1, archives.count())).mapInArrow(_reader(with_payload), kinds)


def read_bytes(raw: bytes) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    return list(read_records(io.BytesIO(raw)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"), min_revisit_bytes=0)
    return read_warc(archives, with_payload=False).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id,
         list_transform(range(8), lambda i: ('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5))::BIGINT) AS parts FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(flatten(list_transform(parts, lambda v: list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS BIGINT), 1)))), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
