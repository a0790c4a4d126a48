"""WARC archives: writing, normalising and reading.

A crawl may come as one gzip stream over the whole file, in which no record can be reached alone. The
normaliser inflates such a stream once, from start to end, writes every record again as a gzip member of its
own, and writes a sidecar index of (offset, length, uri, digest) beside it, so that any record can be read by
one seek.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import arrow_batches, new_path, staged

CRLF = b"\r\n"
END = b"\r\n\r\n"
#: Bytes inflated at a time.
CHUNK = 1 << 20
#: Payload bytes in one archive, about; a larger record stands alone.
ARCHIVE_BYTES = 16 << 20


def open_shared(uri: str, mode: str):
    """A file in the shared folder: local or mounted paths directly, any other store through pyarrow."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_stream(path)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: line breaks would end it."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(kind: str, page_id: str, uri: str | None, digest: str, payload: bytes, refers_to: str | None = None, size: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own; X-Payload-Length tells the full payload's size."""
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}").urn
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"X-Page-Id: {page_id}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload) if size is None else size}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}').urn}>", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return CRLF.join(x.encode("utf-8", "surrogatepass") for x in head) + END + payload + END


class Inflated(io.RawIOBase):
    """The inflated bytes of a gzip file of any number of members, read forward once in bounded memory."""

    def __init__(self, raw):
        self.raw, self.zip, self.rest, self.ready = raw, None, b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.ready:
            data = self.rest or self.raw.read(CHUNK)
            if not data:
                if self.zip is not None:
                    raise ValueError("the gzip stream is cut off")
                return 0
            if self.zip is None:
                self.zip = zlib.decompressobj(31)
            self.ready, self.rest = self.zip.decompress(data, CHUNK), b""
            if self.zip.eof:
                self.rest, self.zip = self.zip.unused_data, None
            else:
                self.rest = self.zip.unconsumed_tail
        n = min(len(out), len(self.ready))
        out[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def parse(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, payload, whole record) of each record of an inflated stream; names of headers are lower-case."""
    while first := stream.readline():
        if first == CRLF:
            continue
        lines = [first]
        while (line := stream.readline()) != CRLF:
            if not line:
                raise ValueError("a record ends within its headers")
            lines.append(line)
        heads = {}
        for line in lines[1:]:
            k, _, v = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(":")
            heads[k.strip().lower()] = v.strip()
        size = int(heads["content-length"])
        payload = stream.read(size)
        if len(payload) != size or stream.read(4) != END:
            raise ValueError("a record is shorter than its Content-Length")
        yield heads, payload, b"".join(lines) + CRLF + payload + END


def write_monolithic(records: Iterable[bytes], out) -> None:
    """One gzip stream over all records, as crawlers that pipe through gzip leave it."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    for r in records:
        out.write(z.compress(r))
    out.write(z.flush())


def normalise(raw, out, index, level: int = 6) -> int:
    """Rewrites the archive raw to out, a gzip member a record, with a line of JSON a record to index; returns the number of records."""
    at = n = 0
    for heads, _, whole in parse(io.BufferedReader(Inflated(raw), CHUNK)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(whole) + z.flush()
        out.write(member)
        line = {"offset": at, "length": len(member), "type": heads["warc-type"], "uri": heads.get("warc-target-uri"), "digest": heads.get("warc-payload-digest")}
        index.write(json.dumps(line).encode() + b"\n")
        at += len(member)
        n += 1
    return n


def read_at(raw: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised archive, by the offset and length that its index tells."""
    return next((h, p) for h, p, _ in parse(io.BytesIO(zlib.decompress(raw[offset : offset + length], 31))))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages(page_id string, uri, payload binary, kind, digest, refers_to, size) as archives; returns their names and numbers of records.

    Each task writes monolithic archives under new names, normalises each, and reports it; what a lost or
    repeated task has left is named by no report, and readers take reported archives only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            name = uuid.uuid4().hex
            with open_shared(f"{folder}/raw/{name}.warc.gz", "wb") as out:
                write_monolithic(held, out)
            with open_shared(f"{folder}/raw/{name}.warc.gz", "rb") as raw, open_shared(f"{folder}/warc/{name}.warc.gz", "wb") as out, open_shared(f"{folder}/index/{name}.jsonl", "wb") as index:
                n = normalise(raw, out, index)
            held.clear()
            size = 0
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [n]}, pa.schema({"archive": pa.string(), "records": pa.int64()}))

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for page_id, uri, payload, kind, digest, refers_to, full in zip(*columns):
                held.append(record_bytes(kind.as_py(), page_id.as_py(), uri.as_py(), digest.as_py(), payload.as_py(), refers_to.as_py(), full.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return pages.mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to) of every record of the reported archives, by their indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_shared(f"{folder}/index/{name}.jsonl", "rb") as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with open_shared(f"{folder}/warc/{name}.warc.gz", "rb") as f:
                    for line in index:
                        f.seek(line["offset"])
                        h, payload = read_at(f.read(line["length"]), 0, line["length"])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"{name}: the payload at {line['offset']} does not have its digest")
                        rows.append((h["x-page-id"], h.get("warc-target-uri"), int(h["x-payload-length"]), digest, h["warc-type"], h.get("x-refers-to-page")))
                if len(rows) != expected:
                    raise ValueError(f"{name}: {len(rows)} records, {expected} were written")
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return archives.mapInArrow(run, "page_id string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def warc_roundtrip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes a record per page to archives in the shared folder, normalises them, and returns what is read back.

    Of equal payloads, of any size, the page with the largest id is the response and the others are revisits
    that name it; null html is an empty payload. Null ids are below all others and come back as null; rows that
    repeat an id are records of their own, and all of those with the largest id are responses. Uris may be
    null. Other columns are not read; an empty table gives an empty result. Groups of equal pages are
    found by digest with map-side combining, whatever their size.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    folder = folder or new_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    # payloads are equal by SHA-256, as others with one SHA-1 are known
    rows = rows.withColumns({"h": F.unhex(F.sha1("payload")), "same": F.unhex(F.sha2("payload", 256))})
    copies = rows.groupBy("same").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("ch"), "keep")
    copies = staged(copies, "warc-copies")  # a join of two scans lets Spark split a payload that very many pages share
    both = rows.join(copies, F.col("same") == F.col("ch"), "left")
    revisit = F.col("ch").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    ready = both.select(
        name.alias("page_id"),
        "uri",
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        "h",
        F.when(revisit, F.col("keep").cast("string")).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("size"),
    )
    done = write_archives(_base32(ready), folder)
    done.write.parquet(f"{folder}/reports")
    reports = spark.read.schema(done.schema).parquet(f"{folder}/reports")
    reports = reports.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    back = read_archives(reports, folder)
    as_id = lambda c: F.when(F.col(c) == "", None).otherwise(F.col(c)).cast(kind)
    return back.select(as_id("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))


def _base32(ready: DataFrame) -> DataFrame:
    """The SHA-1 column h as base32 text: each five bytes make eight letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = [F.conv(F.hex(F.substring("h", 1 + 5 * k, 5)), 16, 10).cast("long") for k in range(4)]
    chars = [F.substring(F.lit(letters), F.shiftright(x, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for x in five for j in range(8)]
    return ready.select("page_id", "uri", "payload", "kind", F.concat(*chars).alias("digest"), "refers_to", "size")
