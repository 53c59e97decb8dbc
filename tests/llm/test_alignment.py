"""Alignment against both libraries and plain loops over all token pairs."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from rillmark.llm import alignment
from rillmark.llm.alignment import Aligner, Fragment, ranges
from rillmark.llm.queries import BYTE_BPE, PIECE_BPE, op11_alignment

A, B = P.path(BYTE_BPE), P.path(PIECE_BPE)
BITS = ["a", " ", "  ", "\n", "Hello", "é", "日本", "🙂", "▁", "<s>", "<|endoftext|>", " ", "'s", "123", "ing", "\t", "und", "ﬁ", "　",
        "x" * 90, "\x00", "\x1c", "́"]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    back = {code: bytes([byte]) for code, byte in alignment._byte_codes().items()}
    return a, back, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, text):
    """(n_a, n_b, groups, groups as text, links by id pair), None without tokens."""
    a, back, b = libraries
    whole, sides = (" " + text).encode(), []
    entries = a.encode(" " + text, add_special_tokens=False)
    tokens_a = [(number, b"".join(back[c] for c in token)) for number, token in zip(entries.ids, entries.tokens)]
    tokens_b = [(number, bytes([int(b.id_to_piece(number)[3:5], 16)]) if b.is_byte(number) else b.id_to_piece(number).replace("▁", " ").encode())
                for number in b.encode(text)]
    for tokens in (tokens_a, tokens_b):
        if not text or b"".join(part for _, part in tokens) != whole:
            return None
        at, spans = 0, []
        for number, part in tokens:
            spans.append((number, at, at + len(part)))
            at += len(part)
        sides.append(spans)
    ends = sorted({end for _, _, end in sides[0]} & {end for _, _, end in sides[1]})
    groups = [[[str(n) for n, _, end in side if low < end <= high] for side in sides] for low, high in zip([0, *ends], ends)]
    links = Counter((x, y) for x, s, e in sides[0] for y, t, f in sides[1] if s < f and t < e)
    return len(sides[0]), len(sides[1]), len(ends), ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups), links


def parts(fragment):
    closed = Fragment.joined([Fragment.start(), fragment]).closed
    links = {(pair >> 32, pair & 0xFFFFFFFF): times for pair, times in zip(closed.pairs.tolist(), closed.times.tolist())}
    return closed.n_a, closed.n_b, closed.n_groups, closed.text, links


def test_fragments_of_any_ranges_join_to_the_whole(libraries):
    rng, aligner, valid = random.Random(1), Aligner(A, B), 0
    for _ in range(600):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 40)))
        want, size = plain(libraries, text), len(text.encode()) + 1
        whole = aligner.fragment(" " + text, 0, size)
        assert whole.valid == (want is not None), repr(text)
        if want is None:
            continue
        valid += 1
        assert parts(whole) == want, repr(text)
        for chunk in (1, 3, 7, 50):
            pieces = [aligner.fragment(piece, low, high, offset) for piece, offset, low, high in ranges(" " + text, chunk)]
            while len(pieces) > 1:  # in any grouping
                at, count = rng.randrange(len(pieces)), rng.randrange(2, 4)
                pieces[at:at + count] = [Fragment.joined(pieces[at:at + count])]
            assert parts(pieces[0]) == want, (repr(text), chunk)
    assert valid > 100


def test_memory_is_bounded_and_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 200)
    rng, aligner = random.Random(2), Aligner(A, B)
    for _ in range(200):
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 20))]
        closed, = aligner.closed([words])
        assert parts(Fragment(True, alignment.Open.none(), closed, alignment.Open.none())) == plain(libraries, " ".join(words))
        assert aligner.held < 500


def test_ranges_cover_a_text_and_keep_long_words_whole():
    text = " " + "ab cd  é\n" * 50 + "x" * 500 + " tail" * 9
    found = list(ranges(text, 64))
    assert [low for _, _, low, _ in found] == [0, *[high for *_, high in found][:-1]] and found[-1][3] == len(text.encode())
    assert all(offset <= low < high <= offset + len(piece.encode()) for piece, offset, low, high in found)
    assert sum(len(piece.encode()) for piece, *_ in found) < 3 * len(text.encode())


def expected(libraries, rows):
    found = [(doc, plain(libraries, text or "")) for doc, text in rows]
    counts = Counter()
    for _, one in found:
        counts.update(one[4] if one else {})
    highest = Counter()
    for (_, b), times in counts.items():
        highest[b] = max(highest[b], times)
    out = []
    for doc, one in found:
        links = one[4] if one else {}
        out.append((doc, *(one[:3] if one else (0, 0, 0)), sum(links.values()),
                    sum(times for pair, times in links.items() if counts[pair] == highest[pair[1]]),
                    sum(times * counts[pair] for pair, times in links.items()),
                    hashlib.sha256(one[3].encode()).hexdigest() if one else ""))
    return sorted(out, key=str)


def test_query(spark, libraries):
    got = op11_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [row for row in docs if len(row["text"] or "") < 3000]  # plain loops over all pairs; the longest are compared as fragments above
    assert {row["doc_id"]: row["groups_sha256"] for row in got.collect() if row["doc_id"] in {r["doc_id"] for r in short}} == {
        row[0]: row[-1] for row in expected(libraries, short)}


def test_odd_rows_long_texts_and_rare_pairs(spark, libraries):
    long = " ".join(f"wörd{n} and" for n in range(120)) + "y" * 300 + " end"
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "unstoppable"), (2, None), (3, ""), (4, "bad ▁ mark"), (5, long), (5, long), (6, " \n x")]
    df = spark.createDataFrame([(doc, text, 7, "z") for doc, text in rows], "doc_id long, text string, n_a long, pair string")
    for chunk, heavy in ((64, 1), (32_768, 65_536), (200, 50)):
        got = alignment.translation(df, A, B, chunk=chunk, heavy=heavy).select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
        assert sorted(map(tuple, got.collect()), key=str) == expected(libraries, rows)
    assert alignment.translation(df.limit(0), A, B).count() == 0


def test_texts_with_white_space_at_their_edges_do_not_change_their_neighbours(libraries):
    rng = random.Random(3)
    for _ in range(300):
        texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, 9))) + rng.choice(["", " ", "  ", "\n", " \n "]) for _ in range(3)]
        aligner = Aligner(A, B)  # all words are new, so they are encoded together
        for text, closed in zip(texts, aligner.closed([aligner.words(text) for text in texts])):
            want = plain(libraries, text)
            assert (closed is None) == (want is None), repr(text)
            assert closed is None or parts(Fragment(True, alignment.Open.none(), closed, alignment.Open.none())) == want, repr(texts)


def test_rows_with_white_space_at_their_edges(spark, libraries):
    rows = list(enumerate(["ends so ", "word after", "  begins", "two  ", " \n", "next\n", "\tlast", " ", "ends so ", "x   ", "more words"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = alignment.translation(df, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert sorted(map(tuple, got.collect()), key=str) == expected(libraries, rows)
