"""Byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps.

A text is split by the tokenizer's pattern into pre-tokens; within each, the adjacent pair of lowest rank is joined until no
pair has a rank. Pending pairs lie in a queue with one bucket per rank: a two-level bitmap says which buckets hold something,
so find-first-set gives the next rank, and a bucket lists positions in the linked list of symbols. An entry whose pair has changed
since is stale and skipped. The pre-tokens of a few texts that are not remembered share one queue. A pre-token of n bytes takes O(n log n) steps however long it is.

Defined results: a null text encodes like an empty one, to no ids; null ids decode to empty bytes; an id without a token
raises ``ValueError``. Rows are independent, so repeated rows, ties and empty tables need nothing special. An input column
named like the output column is replaced.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import quoted

#: Bits in one word of the bitmap.
BITS = 8
#: Single bits, for words of the bitmap and for its top up to a vocabulary of 2**20.
_ONE = [1 << bit for bit in range(4096)]
#: Entries of each generation that a worker remembers, and the longest piece worth it. Both bound memory only.
REMEMBERED, LONGEST = 250_000, 48
#: Texts whose new words share a queue.
TEXTS = 64
#: Bits for the second id of a pair.
SHIFT = 20
MARKS = ".,;:!?"


class Memory:
    """Encodings met lately: when the young generation is full, it becomes the old one."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, piece: str) -> bytes | None:
        if (found := self.young.get(piece)) is None and (found := self.old.get(piece)) is not None:
            self.keep(piece, found)
        return found

    def keep(self, piece: str, packed: bytes) -> None:
        if len(piece) <= LONGEST:
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            self.young[piece] = packed


class Bpe:
    """Ranks, pattern, and bounded memories of what was encoded before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pretoken = regex.compile(pattern)
        blank = regex.compile(r"\s")
        self.blanks = frozenset(c for c in map(chr, range(0x10000)) if blank.match(c))
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known = np.array([token is not None for token in self.tokens], dtype=bool)
        # All tokens in one table of bytes, to decode from.
        self.sizes = np.array([len(token or b"") for token in self.tokens], np.int64)
        self.starts, self.table = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(token or b"" for token in self.tokens), np.uint8)
        # Rank of every pair of tokens that joins to a token, by both ids.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    self.pairs[left << SHIFT | right] = rank
        self.bytes_to_ids = [ranks.get(bytes([byte]), -1) for byte in range(256)]
        # Ids of bytes and ranks of byte pairs as tables; 256 stands for the mark between pre-tokens.
        self.byte_ids = np.array([*self.bytes_to_ids, -1])
        self.byte_pairs = np.full((257, 257), -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = self.pairs.get(self.bytes_to_ids[token[0]] << SHIFT | self.bytes_to_ids[token[1]], -1)
        self.words = Memory()

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str, pattern: str) -> Bpe:
        """The tokenizer of a rank file: lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return Bpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))},
                       pattern)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, as 32-bit integers. They share one queue: pairs never reach over the marks between them."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes + 1) - sizes
        symbols = np.full(int(sizes.sum()) + len(pieces) + 1, 256, np.int64)
        symbols[np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(pieces) + 1), sizes)] = np.frombuffer(b"".join(pieces), np.uint8)
        ids, starts, size, rank_of = self.byte_ids[symbols].tolist(), starts.tolist(), len(symbols), self.pairs.get
        after, before = [*range(1, size + 1)], [*range(-1, size - 1)]  # the linked list of symbols
        # Rank of the pair that starts here, -1 if none.
        first = np.append(self.byte_pairs[symbols[:-1], symbols[1:]], -1)
        pending, places = first.tolist(), np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        found, cuts = np.unique(first[places], return_index=True)
        buckets = {rank: places[low:high].tolist() for rank, low, high in zip(found.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(places)])}
        # The queue: bit g of top is set if groups[g] is not 0, bit b of groups[g] if bucket g * 2**BITS + b holds something.
        top, groups, low, one = 0, {}, (1 << BITS) - 1, _ONE
        for rank in buckets:
            group = rank >> BITS
            groups[group] = groups.get(group, 0) | one[rank & low]
            top |= one[group]
        while top:
            group = (top & -top).bit_length() - 1
            word = groups[group]
            rank = group << BITS | (word & -word).bit_length() - 1
            bucket = buckets.pop(rank)
            groups[group] = word = word & (word - 1)
            if not word:
                top &= top - 1
            bucket.sort()  # the leftmost first
            for done, start in enumerate(bucket, 1):
                if pending[start] != rank:
                    continue  # stale
                gone = after[start]
                end, left = after[gone], before[start]
                ids[start] = rank
                ids[gone] = pending[gone] = -1
                after[start] = end
                before[end] = start
                pending[start] = right_rank = rank_of(rank << SHIFT | ids[end], -1)
                pending[left] = left_rank = rank_of(ids[left] << SHIFT | rank, -1)
                if right_rank >= 0:
                    if right_rank in buckets:
                        buckets[right_rank].append(start)
                    else:
                        buckets[right_rank] = [start]
                        group = right_rank >> BITS
                        groups[group] = groups.get(group, 0) | one[right_rank & low]
                        top |= one[group]
                if left_rank >= 0:
                    if left_rank in buckets:
                        buckets[left_rank].append(left)
                    else:
                        buckets[left_rank] = [left]
                        group = left_rank >> BITS
                        groups[group] = groups.get(group, 0) | one[left_rank & low]
                        top |= one[group]
                elif right_rank < 0:
                    continue
                if 0 <= right_rank <= rank or 0 <= left_rank <= rank:
                    # What comes first now may lie before the rest of this bucket.
                    if rest := bucket[done:]:
                        buckets.setdefault(rank, []).extend(rest)
                        group = rank >> BITS
                        groups[group] = groups.get(group, 0) | one[rank & low]
                        top |= one[group]
                    break
        return [array("i", [i for i in ids[start:start + len(piece)] if i >= 0]).tobytes() for start, piece in zip(starts, pieces)]

    def _pieces(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of texts that are cut into pre-tokens; each distinct pre-token is encoded once."""
        known = {piece: self.ranks.get(piece) for pieces in texts for piece in pieces}
        rest = [piece for piece, rank in known.items() if rank is None]
        known = {piece: array("i", [rank]).tobytes() for piece, rank in known.items() if rank is not None}
        if rest:
            known.update(zip(rest, self.merge(rest)))
        return [b"".join([known[piece] for piece in pieces]) for pieces in texts]

    def _cut(self, chunk: str) -> list[bytes]:
        return [piece.encode() for piece in self.pretoken.findall(chunk)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words, each with the blank before it.

        Marks after a letter are a pre-token of their own, so a word is put together from its core and its marks.
        """
        found, cores, ids, fresh = {}, {}, {}, {}
        for word in words:
            if (packed := self.words.find(word)) is not None:
                found[word] = packed
                continue
            core = word.rstrip(MARKS)
            if not core or not core[-1].isalpha():
                core = word
            cores[word] = core
            if (packed := self.words.find(core)) is not None:
                ids[core] = packed
            elif core not in fresh:
                fresh[core] = [b" " + core.encode()] if core.isalpha() else self._cut(" " + core)
        tails = {word[len(core):] for word, core in cores.items()}
        fresh.update((tail, [tail.encode()]) for tail in tails - {""})  # tails hold marks only, so none is a core
        ids.update(zip(fresh, self._pieces(list(fresh.values()))))
        for word, core in cores.items():
            found[word] = packed = ids[core] + (ids[word[len(core):]] if len(core) < len(word) else b"")
            self.words.keep(core, ids[core])
            self.words.keep(word, packed)
        return found

    def _edges(self, word: str) -> bool:
        """Whether a word begins and ends with something other than white space."""
        return bool(word) and word[0] not in self.blanks and word[-1] not in self.blanks

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as 32-bit integers.

        A single blank between two other characters always begins a pre-token, so texts are cut there first, and each
        word is looked up, with its blank, before it is encoded. New words of all the texts are encoded together.
        """
        out: list[bytes | None] = [None] * len(texts)
        regular, new = [], set()
        for number, text in enumerate(texts):
            words = text.split(" ")
            found = list(map(self.words.young.get, words))
            found[0] = None
            missing = [at for at, packed in enumerate(found) if packed is None]
            if all(self._edges(words[at]) for at in missing):
                regular.append((number, words, found, missing))
                new.update(words[at] for at in missing[1:])
            else:
                out[number] = b"".join(self._pieces([self._cut(chunk) for chunk in self._chunks(words)]))
        learnt = self._learn(new)
        first = self._pieces([self._cut(words[0]) for _, words, _, _ in regular])
        for (number, words, found, missing), start in zip(regular, first):
            for at in missing:
                found[at] = learnt[words[at]] if at else start
            out[number] = b"".join(found)
        return out

    def _chunks(self, words: list[str]) -> Iterator[str]:
        """The text of these words, cut where a single blank stands between two other characters."""
        chunk = [words[0]]
        for last, word in zip(words, words[1:]):
            if last and word and last[-1] not in self.blanks and word[0] not in self.blanks:
                yield " ".join(chunk)
                chunk = ["", word]
            else:
                chunk.append(word)
        yield " ".join(chunk)

    def encode(self, texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), TEXTS):  # few texts at a time as Python strings
            parts += self.packed([text or "" for text in texts.slice(start, TEXTS).to_pylist()])
        return _lists(parts, 4, pa.int32(), np.dtype("<i4"))

    def decode(self, ids: pa.Array) -> pa.Array:
        ids = ids.fill_null([]) if ids.null_count else ids
        offsets = ids.offsets.to_numpy().tolist()
        values = ids.values.to_numpy(zero_copy_only=False)[:offsets[-1]]
        used = values[offsets[0]:]
        if len(used) and not (used.min() >= 0 and used.max() < len(self.known) and self.known[used].all()):
            raise ValueError("an id has no token")
        parts, sizes = [], np.zeros(len(ids) + 1, np.int64)
        for first in range(0, len(ids), 64):  # few texts at a time
            ends = offsets[first:first + 65]
            own = values[ends[0]:ends[-1]]
            wide = self.sizes[own]
            after = np.cumsum(wide)
            places = np.arange(after[-1] if len(after) else 0) + np.repeat(self.starts[own] - after + wide, wide)
            parts.append(self.table[places].tobytes())
            sizes[first + 1:first + len(ends)] = np.diff(np.append(0, after)[np.array(ends) - ends[0]])
        data, limits = b"".join(parts), np.cumsum(sizes)
        if limits[-1] >= 1 << 31:  # too much for one Arrow array of 32-bit offsets
            return pa.array([data[start:end] for start, end in itertools.pairwise(limits.tolist())], pa.large_binary()).cast(pa.binary())
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(data)])


def _lists(parts: list[bytes], width: int, kind: pa.DataType, dtype: np.dtype) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(part) // width for part in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype), kind))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as array<int> in column ``ids``."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return Bpe.load(path, pattern).encode(texts)

    # Not to be evaluated twice when later columns use the ids.
    return df.withColumn(ids, encoded.asNondeterministic()(quoted(text).cast("string")))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of ``ids`` in column ``out``."""

    @F.arrow_udf("binary")
    def decoded(values: pa.Array) -> pa.Array:
        return Bpe.load(path, pattern).decode(values)

    return df.withColumn(out, decoded.asNondeterministic()(quoted(ids)))
