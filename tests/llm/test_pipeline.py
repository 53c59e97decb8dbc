"""The stages against plain Python, and their edges."""

import re

import corpus_pipeline
import tiktoken
from pyspark.sql import functions as F

from rillmark.llm import bpe, mixing, quality


def shingles(text, size=5):
    words = [re.sub("[A-Z]", lambda c: c[0].lower(), word) for word in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def test_run_equals_the_operators_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [row for row in quality.assess(docs).collect() if row["kept"]]
    sets = [(row["doc_id"], shingles(row["clean_text"])) for row in kept]
    label = {doc: doc for doc, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, own in sets:
            for j, other in sets:
                if label[j] < label[i] and len(own & other) >= 0.8 * len(own | other):
                    label[i], changed = label[j], True
    gone = {doc for doc, root in label.items() if doc != root}
    left = [row for row in kept if row["doc_id"] not in gone]
    frame = spark.createDataFrame([(row["doc_id"], row["clean_text"], row["source"]) for row in left], "doc_id long, text string, source string")
    copies = {row["doc_id"]: row["copies"] for row in mixing.rates(frame).collect()}
    ours = bpe.Bpe.load(corpus_pipeline.public_tokenizers.path(corpus_pipeline.RANKS), corpus_pipeline.public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    want = sorted((row["doc_id"], library.encode_ordinary(row["clean_text"])) for row in left for _ in range(copies[row["doc_id"]]))
    got = sorted((row["doc_id"], row["ids"]) for row in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())
    assert got == want and len(gone) > 0


def test_stages_keep_columns_and_take_odd_rows(spark):
    long = " ".join(f"word{n}." for n in range(90))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (None, long + " more", None, None, None), (2, None, None, None, None), (3, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, None)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert stage(spark, docs.limit(0), None).count() == 0
    assert {row["doc_id"] for row in docs.collect()} <= {1}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, None)
    assert last.where(F.size("ids") == 0).count() == 0
