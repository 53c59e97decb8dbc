"""BPE against the public library, and the edges."""

import hashlib

import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rillmark.llm import bpe
from rillmark.llm.queries import RANKS, op1_bpe

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
OURS = bpe.Bpe.load(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})
PIECES = st.sampled_from(["a", "The", " ", "  ", "\n", "'s", "'ll", "é", "é", "\x1c", "\x85", "　", "3", "½", "!?", "😀", ".", "word,"])


def ids_of(text):
    return pa.array([text]).to_pylist() and OURS.encode(pa.array([text]))[0].as_py()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(PIECES, max_size=30).map("".join)))
def test_equals_the_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_long_pieces_and_many_equal_pairs():
    for text in ("ab" * 20_000, "a" * 30_001, " " * 5000, "é" * 3000 + "x", "a  b" * 2000):
        assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_memory_overflow_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Bpe(OURS.ranks, PATTERN)
    text = "one two, three four. five six; one two, seven"
    assert own.encode(pa.array([text, text]))[1].as_py() == LIBRARY.encode_ordinary(text)


def test_round_trip_with_nulls_and_clashing_columns(spark):
    rows = [(1, "héllo  wörld", [7]), (1, "héllo  wörld", None), (None, None, None), (2, "", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    out = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(row["decoded"]).decode() for row in out] == ["héllo  wörld", "héllo  wörld", "", ""]
    assert [row["ids"] for row in out] == [LIBRARY.encode_ordinary(text or "") for _, text, _ in rows]
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


def test_unknown_ids_are_refused():
    with pytest.raises(ValueError):
        OURS.decode(pa.array([[len(OURS.tokens)]], pa.list_(pa.int32())))
    assert OURS.decode(pa.array([None, []], pa.list_(pa.int32()))).to_pylist() == [b"", b""]


def test_query(spark):
    found = {row["doc_id"]: row for row in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids, row = LIBRARY.encode_ordinary(doc["text"]), found[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(doc["text"].encode()).hexdigest()
