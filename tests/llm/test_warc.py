"""WARC: which records are revisits, real archives, payloads back."""

import gzip
import hashlib

import pytest
from pyarrow import fs

from rillmark.llm import warc
from rillmark.llm.queries import op2_warc
from rillmark.session import materialise

BIG, OTHER = "x" * 1500, "é" * 600
ROWS = [(1, "http://u/1", BIG), (2, "u\r\nX: 2", BIG), (3, None, BIG), (3, "u3", BIG), (None, "n", BIG), (4, "a", "short"), (5, "b", "short"),
        (6, "c", None), (7, "d", ""), (None, "e", OTHER), (None, "f", OTHER), (8, "g", "y" * 999), (9, "h", "y" * 999), (10, "i", "z" * 1000),
        (11, "j", "z" * 1000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)


def test_revisits_and_payloads(spark, pages):
    records = materialise(warc.read(warc.write(pages)))
    found = sorted(((row["page_id"], row["url"], row["record_type"], row["refers_to"], bytes(row["payload"]), row["payload_digest"],
                     row["payload_bytes"]) for row in warc.resolve(records).collect()), key=str)
    want = []
    for page, url, html in ROWS:
        data = (html or "").encode()
        original = {BIG: 3, "z" * 1000: 11}.get(html)
        revisit = original is not None and page != original
        want.append((page, "".join(url.splitlines()) if url else None, "revisit" if revisit else "response", original if revisit else None,
                     data, hashlib.sha1(data).hexdigest(), len(data)))
    assert found == sorted(want, key=str)


def test_files_are_gzip_members_with_fresh_headers(spark, pages):
    manifest = warc.write(pages, file_bytes=500, date="2024-01-01T00:00:00Z").collect()
    assert len(manifest) > 3 and sum(row["records"] for row in manifest) == len(ROWS)
    for row in manifest:
        filesystem, name = fs.FileSystem.from_uri(row["file"])
        data = filesystem.open_input_stream(name, compression=None).read()
        assert len(data) == row["bytes"]
        text = gzip.decompress(data).decode()
        assert text.startswith("WARC/1.1\r\n") and text.count("WARC-Date: 2024-01-01T00:00:00Z") == row["records"]


def test_broken_archives_are_refused():
    record = warc._record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, "d")
    assert warc.parse(record)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"hello", b"jello"))


def test_empty(spark, pages):
    assert warc.resolve(materialise(warc.read(warc.write(pages.limit(0))))).count() == 0


def test_query(equals_sql):
    equals_sql(op2_warc)
