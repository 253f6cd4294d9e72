"""WARC archives: one gzip member per record, written and read by tasks.

``write`` gives each task its own archive files in a shared folder, under a
name that no other task or attempt uses, and records them in a manifest that
Spark commits; files of lost or repeated attempts are in no manifest and are
never read.  ``read`` streams the archives of a manifest: each member is
decompressed incrementally in chunks, records are framed by Content-Length,
and block and payload digests are checked while the bytes pass, so no record
is held whole unless its payload is asked for.

Records with equal payloads (of at least ``min_revisit_bytes`` bytes) are
stored once: the one with the largest page_id is the response, the others are
revisits that name it.  A revisit has no payload; its Payload-Digest and
Payload-Length fields are those of the payload it stands for.

Defined results: a null html is an empty payload; a null url gives a record
without a target; a null page_id is never referred to and is a response; rows
that repeat the largest page_id of their payload are all responses (a record
cannot revisit itself).  Control characters in a url are percent-encoded.  An
empty table gives no record; other columns than page_id, url and html are not
read.  A member that ends inside its header or block is a ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.frames import bound_batches, remote_fs, shared_path, stored

CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 28        # a task starts another archive beyond this size
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records bigint, bytes bigint"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DigestError(ValueError):
    pass


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one WARC record (not compressed)."""
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Content-Length: %d\r\n\r\n" % len(payload)) + (b"" if revisit else payload)
    digest = base32_sha1(payload)
    kind = "revisit" if revisit else "response"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}|{kind}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) <= 0x20 or ord(c) == 0x7F else c for c in url))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             f"Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decide(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) with the revisits decided."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    several = (rows.select("page_id", "sha1", F.octet_length("payload").alias("n"))
               .where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull())
               .groupBy("sha1").agg(F.count("*").alias("c"), F.max("page_id").alias("last"))
               .where("c > 1").select("sha1", "last"))
    return rows.join(several, "sha1", "left").select(
        "page_id", "url", "payload", F.expr("IF(page_id < last, last, NULL)").alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``decide`` below ``folder``; returns the manifest."""
    def run(batches):
        fs, base = remote_fs(folder)
        fs.create_dir(base, recursive=True)
        sink, name, count, size = None, "", 0, 0

        def manifest():
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([count]), pa.array([size])], names=["path", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in columns)):
                if sink is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = pack.compress(record(page_id, url, payload, refers, refers is not None)) + pack.flush()
                sink.write(raw)
                count, size = count + 1, size + len(raw)
                if size > ARCHIVE_BYTES:
                    sink.close()
                    sink = None
                    yield manifest()
        if sink is not None:
            sink.close()
            yield manifest()

    bound_batches(rows.sparkSession)
    return stored(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, MANIFEST), "warc-manifest")


def members(source) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed chunks.
    A member must be consumed before the next is asked for."""
    pending = b""
    while True:
        if not pending:
            pending = source.read(CHUNK)
            if not pending:
                return
        unpack = zlib.decompressobj(31)

        def chunks():
            nonlocal pending
            while not unpack.eof:
                if not pending:
                    pending = source.read(CHUNK)
                    if not pending:
                        raise EOFError("archive ends within a gzip member")
                out = unpack.decompress(pending, CHUNK)
                pending = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if out:
                    yield out
        yield chunks()


def _more(chunks: Iterator[bytes], where: str) -> bytes:
    part = next(chunks, None)
    if part is None:
        raise ValueError(f"a record ends inside its {where}")
    return part


def read_record(chunks: Iterator[bytes], with_payload: bool = False) -> dict:
    """Parse and verify one record from the decompressed chunks of its member."""
    data = b""
    while b"\r\n\r\n" not in data:
        data += _more(chunks, "header")
    head, data = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    left = int(fields["content-length"])
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    http, n_payload, in_payload = b"", 0, False
    while True:
        part, data = data[:left], data[left:]
        left -= len(part)
        block.update(part)
        if not in_payload:
            http += part
            if b"\r\n\r\n" in http:
                part, in_payload = http.split(b"\r\n\r\n", 1)[1], True
            else:
                part = b""
        payload.update(part)
        n_payload += len(part)
        if with_payload:
            kept.append(part)
        if not left:
            break
        data = _more(chunks, "block")
    tail = data + b"".join(chunks)
    if tail != b"\r\n\r\n":
        raise ValueError("a record must end with two line breaks")

    def check(field, digest):
        said = fields.get(field, "")
        found = base64.b32encode(digest.digest()).decode()
        if said != f"sha1:{found}":
            raise DigestError(f"{field}: {said} stored, {found} read")
    check("warc-block-digest", block)
    revisit = fields["warc-type"] == "revisit"
    if not revisit:
        check("warc-payload-digest", payload)
        if n_payload != int(fields["payload-length"]):
            raise ValueError("payload length differs")
    out = {"page_id": int(fields["page-id"]) if "page-id" in fields else None,
           "url": fields.get("warc-target-uri"), "payload_bytes": int(fields["payload-length"]),
           "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
           "record_type": fields["warc-type"],
           "refers_to": int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None}
    if with_payload:
        out["payload"] = None if revisit else b"".join(kept)
    return out


RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint")
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of a manifest's archives; ``payload`` (binary, null for a
    revisit) only if asked for."""
    schema = RECORD + ", payload binary" * with_payload
    types = _TYPES + [pa.binary()] * with_payload
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, base = remote_fs(path)
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(base, compression=None) as source:
                    for chunks in members(source):
                        rows.append(read_record(chunks, with_payload))
                        seen += 1
                        held += len(rows[-1].get("payload") or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{path} holds {seen} records, its manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    n = max(1, manifest.count())           # archives, one task each
    return manifest.select("path", "records").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark: SparkSession = pages.sparkSession
    return read(write(decide(pages, min_revisit_bytes), shared_path(spark, "warc")), with_payload)
