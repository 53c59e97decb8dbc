"""Token ids in directly addressable codes.

An id is split into chunks of ``CHUNK_BITS`` bits, lowest first. Level k holds the chunk k of every id that has one, packed, and a
bitmap that says which of them go on at the next level; a directory counts the set bits before each ``BLOCK`` of the bitmap.
The place of an id at the next level is the rank of its bit, so any id is read by as many steps as it has chunks, without
decoding its neighbours.

A segment is one row of the stored table: a run of documents in ascending id with their cut points and the levels. Its bytes:
magic, version, chunk bits, number of levels, documents and ids; then the cut points; then per level the number of chunks, the
bitmap, the directory and the chunks (all little-endian, each part padded to 8 bytes).

Defined results: a null text is an empty one, and holds the end id only; null ids come first, ties in the order of text hash; equal
rows follow each other; an empty table writes no segment. Extra columns are not stored.

Scale: texts are encoded where they are read and only packed ids are exchanged, by ranges of the document id; a segment closes at
``SEGMENT`` ids, except that one document stays whole. Starts come from a sum per segment, so nothing but one row per segment
is ever ordered in one task.
"""

from __future__ import annotations

import string
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer

from rillmark.llm.common import id_cell, quoted
from rillmark.session import materialise

CHUNK_BITS = 8
BLOCK = 512
SEGMENT = 1_000_000
REMEMBERED, LONGEST = 300_000, 48
#: ASCII punctuation but the apostrophe, which contractions begin with.
MARKS = string.punctuation.replace("'", "").encode()
SEPARATOR = "\ue000"
_HEAD = struct.Struct("<4sHHIIQ")


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack(documents: list[np.ndarray]) -> bytes:
    """A segment of these documents' ids."""
    cuts = np.concatenate([[0], np.cumsum([len(ids) for ids in documents])]).astype("<u8")
    rest = np.concatenate([np.zeros(0, np.uint32), *documents]).astype(np.uint32)
    levels = []
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> CHUNK_BITS
        on = rest > 0
        bitmap = np.packbits(on, bitorder="little")
        blocks = np.add.reduceat(on, np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0)
        directory = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append(struct.pack("<Q", len(chunk)) + _padded(bitmap.tobytes()) + _padded(directory.tobytes()) + _padded(chunk.tobytes()))
        rest = rest[on]
        if not len(rest):
            break
    return _HEAD.pack(b"DACS", 1, CHUNK_BITS, len(levels), len(documents), int(cuts[-1])) + cuts.tobytes() + b"".join(levels)


class Segment:
    """Reads a packed segment in place."""

    def __init__(self, data: bytes):
        magic, version, bits, levels, documents, self.size = _HEAD.unpack_from(data)
        if magic != b"DACS" or version != 1 or bits != CHUNK_BITS:
            raise ValueError("not a segment of directly addressable codes")
        at = _HEAD.size
        self.cuts = np.frombuffer(data, "<u8", documents + 1, at)
        at += 8 * (documents + 1)
        self.levels = []
        for _ in range(levels):
            (count,) = struct.unpack_from("<Q", data, at)
            at += 8
            bitmap = np.frombuffer(data, np.uint8, -(-count // 8), at)
            at += -(-len(bitmap) // 8) * 8
            directory = np.frombuffer(data, "<u4", -(-count // BLOCK) + 1, at)
            at += -(-len(directory) * 4 // 8) * 8
            chunks = np.frombuffer(data, np.uint8, count, at)
            at += -(-count // 8) * 8
            self.levels.append((bitmap, directory, chunks))

    def get(self, place: int) -> int:
        """The id at one place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for depth, (bitmap, directory, chunks) in enumerate(self.levels):
            value |= int(chunks[place]) << (CHUNK_BITS * depth)
            if not bitmap[place >> 3] >> (place & 7) & 1:
                break
            place = self._rank(bitmap, directory, place)
        return value

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, place: int) -> int:
        """Set bits before a place."""
        block = place // BLOCK
        bits = np.unpackbits(bitmap[block * BLOCK // 8:(place >> 3) + 1], bitorder="little")
        return int(directory[block]) + int(bits[:place - block * BLOCK].sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range; reads only its own chunks of each level."""
        start, stop = max(0, start), min(stop, self.size)
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out))
        for depth, (bitmap, directory, chunks) in enumerate(self.levels):
            if stop <= start:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << (CHUNK_BITS * depth)
            on = np.unpackbits(bitmap[start >> 3:(stop + 7) >> 3], bitorder="little")[start & 7:(start & 7) + stop - start]
            start = self._rank(bitmap, directory, start)
            where = where[on.astype(bool)]
            stop = start + len(where)
        return out

    def document(self, at: int) -> np.ndarray:
        return self.slice(int(self.cuts[at]), int(self.cuts[at + 1]))


class Words:
    """A tokenizers file that drops white space: words are encoded one by one and remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # Letters as the tokenizer's model takes them: one character for each byte of UTF-8, printable ones as they are.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (byte for byte in range(256) if byte not in plain)
        self.letters = {byte: byte for byte in plain} | {byte: 256 + number for number, byte in enumerate(others)}
        probes = ["a", "thing", "Über", "ñandú", "ÉCOLE", "qzxk", "naïveté"]
        self.direct = all(self._letters(probe) == np.array(self.tokenizer.encode(probe, add_special_tokens=False).ids, "<u4").tobytes()
                          for probe in probes)
        self.between = np.array(self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids, "<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _letters(self, text: str) -> bytes | None:
        """Ids of a word of Latin letters, which is one pre-token; None for any other."""
        lowered = text.lower()
        if not lowered.isalpha():
            return None
        if not lowered.isascii():
            if len(lowered) != len(text) or max(text) >= "\u0250":
                return None
            lowered = lowered.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(lowered)]).tobytes()

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Joined by a separator, they take one call; its ids come from no other text."""
        texts = [word.decode() for word in words]
        if any(SEPARATOR in text for text in texts):
            return [np.array(one.ids, "<u4").tobytes() for one in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode(f" {SEPARATOR} ".join(texts), add_special_tokens=False).ids, "<u4")
        size = len(self.between)
        cuts = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids, size).__eq__(self.between).all(axis=1)) if len(
            ids) >= size else np.zeros(0, int)
        if len(cuts) != len(words) - 1:
            raise ValueError("the tokenizer does not keep the separator apart")
        return [ids[start:end].tobytes() for start, end in zip([0, *(cuts + size)], [*cuts, len(ids)])]

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Words:
        return Words(path)

    def _part(self, part: bytes) -> bytes | None:
        """Ids of what is remembered, or of letters by the model itself; None for what the whole tokenizer must see."""
        ids = self.young.get(part)
        if ids is None and (ids := self.old.get(part)) is None and self.direct and (ids := self._letters(part.decode())) is not None:
            if len(part) <= LONGEST:
                self.young[part] = ids
        return ids

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the young generation does not hold.

        Marks after a letter or digit are a token of their own, so a word is put together from its core and its tail.
        """
        found, pending, unknown = {}, [], set()
        for word in words:
            if (ids := self.old.get(word)) is None:
                core = word.rstrip(MARKS)
                if len(core) != len(word) and core and _letter_ends(core):
                    parts = (core, word[len(core):])
                    known = [self._part(part) for part in parts]
                else:
                    parts = (word,)
                    known = [self._part(word)]
                if None in known:
                    unknown.update(part for part, one in zip(parts, known) if one is None)
                    pending.append((word, parts))
                    continue
                ids = b"".join(known)
            found[word] = ids
        if unknown:
            rest = list(unknown)
            fresh = dict(zip(rest, self._joined(rest)))
            for word, parts in pending:
                found[word] = b"".join(fresh[part] if part in fresh else self._part(part) for part in parts)
            self.young.update((part, ids) for part, ids in fresh.items() if len(part) <= LONGEST)
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        self.young.update((word, ids) for word, ids in found.items() if len(word) <= LONGEST)
        return found

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit integers; the white space of bytes.split() never lies within a token."""
        words = text.encode().split()
        found = list(map(self.young.get, words))
        if None in found:
            missing = [at for at, ids in enumerate(found) if ids is None]
            learnt = self._learn({words[at] for at in missing})
            for at in missing:
                found[at] = learnt[words[at]]
        return b"".join(found)


def _letter_ends(word: bytes) -> bool:
    """Whether a word ends with a Latin letter or a digit."""
    if word[-1] < 0x80:
        return word[-1:].isalnum()
    last = word[-2:].decode(errors="replace")[-1]
    return last.lower().isalpha() and last < "\u0250"  # some grow a mark when lowered


def encode(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``packed`` (the ids of the text, then ``end_id``, as little-endian integers of ``Words.width`` bytes), ``tie``."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        words = Words.load(path)
        kind, end, out = f"<u{words.width}", np.array([end_id], "<u4").tobytes(), []
        for start in range(0, len(texts), 256):  # few texts at a time as Python strings
            for text in texts.slice(start, 256).to_pylist():
                out.append(np.frombuffer(words.packed(text or "") + end, "<u4").astype(kind).tobytes())
        return pa.array(out, pa.binary())

    return df.select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("tie"),
                     packed.asNondeterministic()(quoted(text).cast("string")).alias("packed"))


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
          segment: int = SEGMENT) -> None:
    """Write segments to ``path``: ``part``, ``number`` (order within the part), ``first_id``, ``doc_ids``, ``n_tokens``, ``data``."""

    encoded = encode(df, tokenizer, end_id, doc_id, text)
    cell = id_cell(df, doc_id, F.col("doc_id"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, size = 0, [], [], 0
        kind = f"<u{Words.load(tokenizer).width}"

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "doc_ids": ids, "n_tokens": size, "data": pack(held)}],
                pa.schema([("part", pa.int32()), ("number", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                           ("n_tokens", pa.int64()), ("data", pa.binary())]))

        part = 0
        for batch in batches:
            for own, doc, packed in zip(*(batch.column(name).to_pylist() for name in ("part", "doc_id", "packed"))):
                tokens = np.frombuffer(packed, kind)
                if held and (own != part or size + len(tokens) > segment):
                    yield close()
                    number, held, ids, size = number + 1, [], [], 0
                part = own
                held.append(tokens)
                ids.append(doc)
                size += len(tokens)
        if held:
            yield close()

    # Not repartitionByRange: its sample would encode everything once more.
    placed = encoded.withColumn("part", cell).repartition("part")
    ordered = placed.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    ordered.select("part", "doc_id", "packed").mapInArrow(
        segments, "part int, number long, doc_ids array<long>, n_tokens long, data binary").write.parquet(path)


def read(df: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``packed`` of every document in a table of segments."""
    sizes = df.select("part", "number", "n_tokens")
    # One row per part is ordered in one task, the segments of a part in another.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(sizes.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select(
        "part", "number", (F.col("base") + F.col("within")).alias("start")), "codes-starts")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.column("data")[row].as_py())
                ids = batch.column("doc_ids")[row].values
                first = batch.column("start")[row].as_py()
                cuts = segment.cuts.astype(np.int64)
                for low in range(0, len(ids), 1024):
                    high = min(low + 1024, len(ids))
                    packed = [segment.document(at).astype("<u4").tobytes() for at in range(low, high)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(low, high - low), pa.array(cuts[low:high] + first), pa.array(np.diff(cuts[low:high + 1])),
                         pa.array(packed, pa.binary())], ["doc_id", "start", "n_tokens", "packed"])

    joined = df.select("part", "number", "doc_ids", "data").join(starts, ["part", "number"]).select("doc_ids", "data", "start")
    found = joined.mapInArrow(documents, "doc_id long, start long, n_tokens long, packed binary")
    return found.select("doc_id", "start", "n_tokens", F.crc32("packed").cast("long").alias("ids_crc32"), "packed")
