"""WARC archives of web pages: a writer that stores equal payloads once, and a sequential reader.

Every record is one gzip member. The reader decompresses incrementally, frames records by their content length and
verifies their digests, so its memory does not depend on the size of a record or an archive. Archives go through
``pyarrow.fs`` to the folder that driver and executors share; a written manifest lists those of successful tasks only.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.llm.common import scratch_path, slices, written

#: Smaller payloads are always stored in full.
MIN_REVISIT_BYTES = 1000
#: An archive is closed once it holds so many compressed bytes; archives are what the reader's tasks share out.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is cut short, badly framed, or fails its digests."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}{salt}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit of page ``refers_to`` that keeps the HTTP head only."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to) if revisit else None),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(top.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source, rest: bytes) -> None:
        self.source, self.raw, self.zip, self.held = source, rest, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Decompresses another chunk; False at the member's end."""
        while not self.zip.eof:
            data = self.zip.unconsumed_tail or self.raw or self.source.read(CHUNK)
            self.raw = b""
            if not data:
                raise WarcError("archive ends inside a record")
            try:
                got = self.zip.decompress(data, CHUNK)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most or not self.more():
                raise WarcError("record without a complete head")
        got, self.held = self.held[:at], self.held[at + len(mark) :]
        return got

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise WarcError("record shorter than its content length")
            got, self.held = self.held[:n], self.held[n:]
            n -= len(got)
            yield got

    def finish(self) -> bytes:
        """Requires the record's closing line ends and nothing after them; returns what follows the member."""
        if b"".join(self.exactly(4)) != b"\r\n\r\n" or self.held or self.more():
            raise WarcError("record longer than its content length")
        return self.zip.unused_data


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def _digest_of(value: str) -> bytes:
    return base64.b32decode(value.removeprefix("sha1:"))


def read_records(source, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an open archive in order; :class:`WarcError` on bad framing or a digest that doesn't match."""
    rest = source.read(CHUNK)
    while rest:
        member = _Member(source, rest)
        fields = _fields(member.until(b"\r\n\r\n"))
        if not fields[""].startswith("WARC/"):
            raise WarcError("not a WARC record")
        length, block, payload, kept, head = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1(), [], b""
        in_head, size = True, 0
        for part in member.exactly(length):
            block.update(part)
            if in_head:
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_head, part, head = False, head[at + 4 :], head[:at]
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        rest = member.finish() or source.read(CHUNK)
        revisit = fields["warc-type"] == "revisit"
        stated = _digest_of(fields["warc-payload-digest"])
        if block.digest() != _digest_of(fields["warc-block-digest"]) or not revisit and payload.digest() != stated:
            raise WarcError(f"digest mismatch in {fields['warc-record-id']}")
        full = int(_fields(b"\r\n".join([b"", head]))["content-length"])
        if in_head or not revisit and size != full:
            raise WarcError(f"bad HTTP message in {fields['warc-record-id']}")
        number = lambda k: int(fields[k]) if k in fields else None
        yield {
            "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": full, "payload_digest": stated.hex(),
            "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload": b"".join(kept) if keep_payload else None,
        }


def revisits(df: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, key, refers_to) of the pages whose payload another page with a larger id stores. Only keys and ids shuffle."""
    light = df.select(F.col(id_col).alias("id"), F.sha2(F.col(html_col), 256).alias("key")).where(F.octet_length(F.col(html_col)) >= min_bytes)
    groups = light.groupBy("key").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return light.join(written(groups, "payloads"), "key").where("refers_to IS NOT NULL AND NOT (id <=> refers_to)").distinct()


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record per row and returns the manifest (path, records, bytes).

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least ``min_bytes`` the one with the
    largest id is a response and the others revisit it; where that id occurs twice both are responses. Pages without id
    revisit pages with one. Null urls are left out of the record. No rows in, no archives. Other columns are not read.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "archives")
    again = written(revisits(df, id_col, html_col, min_bytes), "revisits")
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = pages.withColumn("key", F.sha2("html", 256)).alias("p").join(again.alias("r"), F.expr("p.id <=> r.id AND p.key = r.key"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(root if "://" in root or ":/" in root else f"file://{root}")
        files.create_dir(folder, recursive=True)
        done, sink, path, records, size = [], None, "", 0, 0

        def close():
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append((path, records, size))
                sink = None

        for batch in slices(batches, 2):
            for ident, url, html, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(path, compression=None)
                data = record(ident, url, html.encode(), other)
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    rows = keyed.select("p.id", "p.url", "p.html", F.col("r.refers_to").cast("long").alias("refers_to"))
    manifest = written(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")
    return manifest.withColumn("root", F.lit(root))


def read_archives(spark: SparkSession, manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of a manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest (bare hexadecimal SHA-1) are those of the full payload, for revisits as stated in the record. With
    ``keep_payload`` a column payload holds what the record stores. A damaged archive raises.
    """
    fields = [("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "long")]
    if keep_payload:
        fields.append(("payload", pa.binary(), "binary"))
    schema = pa.schema([f[:2] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, _ = fs.FileSystem.from_uri(root if "://" in root or ":/" in root else f"file://{root}")
                with files.open_input_stream(path, compression=None) as source:
                    rows, held = [], 0
                    for row in read_records(source, keep_payload):
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = manifest.select("path", "root").repartition(tasks)
    return paths.mapInArrow(run, ", ".join(f"{n} {k}" for n, _, k in fields))


def warc_roundtrip(df: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes every page of ``df`` (page_id, url, html) to archives and reads them back. Cases: :func:`write_archives`."""
    return read_archives(df.sparkSession, write_archives(df, min_bytes=min_bytes)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
