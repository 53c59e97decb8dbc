"""WARC archives without repeated payloads.

Headers (id, payload length, SHA-1 of the payload) are grouped by digest; of records with equal payloads of ``LEAST`` bytes or more,
the one with the largest id is the response and the others become revisit records that name it. Every record gets fresh
headers. Archives are files of gzip members, one per record, as the format asks for. Reading joins revisits to their responses.

Defined results: a null payload is an empty one; a null url leaves out the target header; a null id is never the response of a group,
unless all its ids are null, in which case all are responses; rows that repeat the largest id are responses each; an
empty table writes no archive. Extra columns are not stored.

Scale: copies of one digest are pre-aggregated to one row per task. Payloads move only for the join with digests that repeat, which
Spark broadcasts below its threshold and else splits at a hot digest. A task streams its records to files of at most ``FILE``
bytes, whose names no other attempt uses, and the stored manifest names those of the attempts that counted; so a lost executor
leaves at most a file that nothing names. Archives are written with pyarrow's file systems (local, HDFS, S3, GCS), as Spark has no
writer for them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import quoted
from rillmark.session import materialise, new_path

LEAST = 1000
FILE = 1 << 30
#: Bytes of payloads in one batch of a reader.
BATCH = 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = "file string, records long, bytes long"
_RECORD = ("record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, "
           "refers_to_record string, payload binary")


def headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``payload_bytes``, ``payload_digest`` (hex SHA-1)."""
    payload = F.coalesce(quoted(html).cast("string"), F.lit("")).cast("binary")
    return pages.select(quoted(page_id).cast("long").alias("page_id"), quoted(url).cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def originals(found: DataFrame, least: int = LEAST) -> DataFrame:
    """``payload_digest``, ``original``: the largest id of every payload that occurs more than once."""
    large = found.where(F.col("payload_bytes") >= least)
    return large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where(
        "n > 1 and original is not null").select("payload_digest", "original")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, date: str) -> bytes:
    revisit = original is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(original, digest)}", f"WARC-Profile: {_PROFILE}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    block = _HTTP.encode() + (b"" if revisit else payload)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str | None = None, least: int = LEAST, page_id: str = "page_id", url: str = "url",
          html: str = "html", date: str | None = None, file_bytes: int = FILE) -> DataFrame:
    """Write archives to ``path`` (a new shared folder if None); the stored manifest: ``file``, ``records``, ``bytes``."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = headers(pages, page_id, url, html)
    repeated = materialise(originals(found.select("page_id", "payload_bytes", "payload_digest"), least), "warc-originals")
    resolved = found.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("original"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = fs.FileSystem.from_uri(path)
        filesystem.create_dir(folder, recursive=True)
        out, name, records, size = None, "", 0, 0
        names = ("page_id", "url", "payload", "payload_digest", "original")

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for row in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, size = filesystem.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                own = [batch.column(column)[row].as_py() for column in names]
                member = gzip.compress(_record(own[0], own[1], own[2], own[3], own[4], date), compresslevel=4, mtime=0)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    written = resolved.mapInArrow(archives, _MANIFEST)
    return materialise(written.withColumn("file", F.concat(F.lit(path.rstrip("/") + "/"), "file")), "warc-manifest")


def _members(stream) -> Iterator[bytes]:
    """The records of an archive, one gzip member each, in bounded reads."""
    data, inflate, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        parts.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(record: bytes) -> dict:
    """Fields of one record; the payload of a revisit is None."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    payload = None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if payload is not None and hashlib.sha1(payload).hexdigest() != named:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    return {"record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
            "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "url": fields.get("WARC-Target-URI"),
            "payload_bytes": None if payload is None else len(payload), "payload_digest": named,
            "refers_to_record": fields.get("WARC-Refers-To"), "payload": payload}


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the archives in a manifest, one task per file: ``record_id``, ``record_type``, ``page_id``, ``url``,
    ``payload_bytes``, ``payload_digest``, ``refers_to_record``, ``payload`` (null without ``payload``, and in revisits)."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()),
                        ("payload", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                filesystem, name = fs.FileSystem.from_uri(file)
                with filesystem.open_input_stream(name, compression=None) as stream:
                    rows, size = [], 0
                    for member in _members(stream):
                        row = parse(member)
                        size += len(member)
                        rows.append(row if payload else row | {"payload": None})
                        if size >= BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(records, _RECORD)


def resolve(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``records`` (stored) with ``refers_to``, the id of a revisit's response, and the response's length and payload."""
    responses = records.where("record_type = 'response'")
    wanted = responses.where(F.col("payload_bytes") >= least).dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("own_bytes"),
        F.col("payload").alias("own_payload"))
    revisits = records.where("record_type = 'revisit'").join(wanted, "refers_to_record", "left")
    columns = ["page_id", "url", "record_type", "payload_digest"]
    return responses.select(*columns, "payload_bytes", F.lit(None).cast("long").alias("refers_to"), "payload").unionByName(
        revisits.select(*columns, F.col("own_bytes").alias("payload_bytes"), "refers_to", F.col("own_payload").alias("payload")))

