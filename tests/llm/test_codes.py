"""Directly addressable codes: round trips, random access, and the query against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rillmark.llm import codes
from rillmark.llm.queries import END_ID, WORD_BPE, op7_codes

PATH = public_tokenizers.path(WORD_BPE)
WORDS = codes.Words.load(PATH)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
PIECES = st.sampled_from(["The", "thé", "İ", "ẖ", "H̱", "a", ".", ",!", " ", "\n", "\x1c", "　", "'s", "3", "ñ;", "…", "",
                          "<|endoftext|>", "é", "Σς"])


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(PIECES, max_size=25).map("".join)))
def test_words_equal_the_library(text):
    assert np.frombuffer(WORDS.packed(text), "<u4").tolist() == library_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=60), max_size=8))
def test_segment_round_trip(documents):
    segment = codes.Segment(codes.pack([np.array(ids, np.uint32) for ids in documents]))
    flat = [one for ids in documents for one in ids]
    assert [segment.document(at).tolist() for at in range(len(documents))] == documents
    assert [segment.get(at) for at in range(len(flat))] == flat
    assert segment.slice(3, 9).tolist() == flat[3:9]


def test_random_access_over_many_blocks():
    ids = np.random.default_rng(1).integers(0, 60_000, 20_000).astype(np.uint32)
    segment = codes.Segment(codes.pack([ids]))
    assert all(segment.get(at) == ids[at] for at in range(0, 20_000, 97))
    assert (segment.slice(511, 1537) == ids[511:1537]).all()
    with pytest.raises(IndexError):
        segment.get(20_000)


def test_write_and_read_edges(spark, path):
    rows = [(5, "b c", 1), (None, "z", 2), (5, "b c", 3), (1, None, 4), (2, "", 5), (9, "w " * 3000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    codes.write(df, path, PATH, END_ID, segment=4)
    found = sorted(codes.read(spark.read.parquet(path)).collect(), key=lambda row: row["start"])
    assert [row["doc_id"] for row in found] == [None, 1, 2, 5, 5, 9]
    start = 0
    texts = {None: "z", 1: "", 2: "", 5: "b c", 9: "w " * 3000}
    for row in found:
        ids = np.array([*library_ids(texts[row["doc_id"]]), END_ID], "<u4").tobytes()
        assert (row["start"], row["n_tokens"], row["ids_crc32"], bytes(row["packed"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    codes.write(df.limit(0), path + "-empty", PATH, END_ID)
    assert codes.read(spark.read.parquet(path + "-empty")).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    found = {row["doc_id"]: row for row in op7_codes(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for doc in docs:
        ids = np.array([*library_ids(doc["text"] or ""), END_ID], "<u4").tobytes()
        row = found[doc["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
