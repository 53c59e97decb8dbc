"""Alignment of two tokenizers by an associative monoid of fragments.

Both tokenizers cut the same bytes, a blank and the text. The byte offsets where tokens of both end cut the tokens into groups; tokens of
both whose byte ranges overlap are linked, within their group. A ``Fragment`` is what a byte range knows of this by itself: the tokens
that end in it up to its first common end (an open prefix, whose group may begin further left), closed groups, and the tokens after its
last common end (an open suffix). Putting two neighbours together closes the group between them; this is associative, so fragments of a
very long text, taken side by side in Spark tasks, are put together in a tree. A text of at most ``CHUNK`` bytes is one fragment.

Neither tokenizer has tokens over a single blank between two characters other than white space, and what stands there begins a token of
both. Texts are encoded from one such blank to the next, and the closed fragments of such pieces are remembered. Byte ranges of a long
text are cut anywhere, also within a token; a task encodes the pieces that its range touches and keeps the tokens that end in the range.

The count of an id pair is the number of links in all texts that hold it. Pairs with a share of at least 1 / ``HEAVY`` of all links,
so at most ``HEAVY`` of them, are broadcast; links of the others are shuffled.

Defined results: texts that are null or empty, or of which a tokenizer does not give back the bytes, have no tokens, zeros, and ''
as groups; null ids and repeated rows stay rows of their own; an empty table gives an empty result. Only the id and the text are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import quoted
from rillmark.session import materialise

#: Bytes of a range of a long text, fragments put together by one task, pairs that may be broadcast.
CHUNK, FAN, HEAVY = 32_768, 8, 65_536
#: Characters of remembered pieces in a worker, and the longest piece worth it. Both bound memory only.
REMEMBERED, LONGEST = 2_500_000, 64
#: Bits for the second id of a pair.
SHIFT = 32
_SPACES = np.array([code for code in range(0x10000) if chr(code).isspace()], np.uint32)


class Tokenizer:
    """Ids of texts that begin with a blank, and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(number) for number in range(model.get_piece_size())]
            self.bytes = [bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode()
                          for number, piece in enumerate(pieces)]
            if any(b" " in token.lstrip(b" ") for token in self.bytes):
                raise ValueError(f"{path} has a piece with a blank after another character")
            self.ids = lambda text: model.encode(text[1:], num_threads=1)  # the model adds the first blank
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.encode_special_tokens = True
            codes = _byte_codes()
            vocabulary = model.get_vocab(with_added_tokens=False)
            self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
            for token, number in vocabulary.items():
                self.bytes[number] = bytes(codes[c] for c in token) if all(c in codes for c in token) else token.encode()
            self.ids = lambda text: model.encode(text, add_special_tokens=False).ids
        self.sizes = np.array([len(token) for token in self.bytes], np.int64)

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> Tokenizer:
        return Tokenizer(path)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and byte ends of a text, or None if the bytes of its tokens are others than its own."""
        ids = self.ids(text)
        if b"".join(map(self.bytes.__getitem__, ids)) != text.encode():
            return None
        ids = np.array(ids, np.int64)
        return ids, np.cumsum(self.sizes[ids])


def _byte_codes() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(0x100 + at): byte for at, byte in enumerate(others)}


def _counted(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct links, ascending, and how often each stands there."""
    ordered = np.sort(links)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


@dataclass
class Closed:
    """Groups that are closed on both sides."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def joined(parts: list[Closed]) -> Closed:
        parts = [part for part in parts if part.n_groups]
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return Closed()
        pairs, where = np.unique(np.concatenate([part.pairs for part in parts]), return_inverse=True)
        times = np.bincount(where, np.concatenate([part.times for part in parts]), len(pairs)).astype(np.int64)
        return Closed(sum(part.n_a for part in parts), sum(part.n_b for part in parts), sum(part.n_groups for part in parts),
                      ";".join([part.text for part in parts]), pairs, times)


@dataclass
class Open:
    """Tokens of both tokenizers, with their byte ends, whose group is not closed yet."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    @staticmethod
    def none() -> Open:
        return Open(*[np.zeros(0, np.int64)] * 4)

    def __add__(self, other: Open) -> Open:
        return Open(*[np.concatenate(two) for two in zip(self.parts(), other.parts())])

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def cut(self, low: int, high: int) -> Open:
        """The tokens that end after ``low`` and not after ``high``."""
        a, b = ((ends > low) & (ends <= high) for ends in (self.a_ends, self.b_ends))
        return Open(self.a[a], self.a_ends[a], self.b[b], self.b_ends[b])

    def moved(self, by: int) -> Open:
        return Open(self.a, self.a_ends + by, self.b, self.b_ends + by)

    def closed(self) -> Closed:
        """As groups: the last tokens of both end together, the first begin together."""
        if not len(self.a):
            return Closed()
        texts, at, links, _ = _aligned(self, self.a_ends[-1:])
        return Closed(len(self.a), len(self.b), len(_merged(self.a_ends, self.b_ends)[1]), texts[0], *_counted(links))


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of two ascending arrays without repeats, each once, and those of both."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    again = both[1:] == both[:-1]
    return both[np.append(True, ~again)[:len(both)]], both[1:][again]


def _aligned(tokens: Open, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Groups as text for each part of the tokens up to common ``ends``, and the part of each link, the links, the part of each group."""
    steps, common = _merged(tokens.a_ends, tokens.b_ends)  # each range between two ends lies in one token of both: a link
    links = tokens.a[np.searchsorted(tokens.a_ends, steps)] << SHIFT | tokens.b[np.searchsorted(tokens.b_ends, steps)]
    # Tokens in the order of the text: by group, those of a first.
    kind = np.concatenate([2 * np.searchsorted(common, tokens.a_ends), 2 * np.searchsorted(common, tokens.b_ends) + 1])
    order = np.argsort(kind, kind="stable")
    ids, kind = np.concatenate([tokens.a, tokens.b])[order], kind[order]
    following = np.append(kind[1:], -1)
    marks = np.where(following == kind, 0, np.where(following >> 1 == kind >> 1, 1, 2))
    written = list(map(str, ids.tolist()))
    whole = "".join([part for two in zip(written, map(",|;".__getitem__, marks.tolist())) for part in two])
    sizes = np.cumsum(np.fromiter(map(len, written), np.int64, len(written)) + 1)
    # The last token of each part is the last one whose group ends at the part's end.
    stops = sizes[np.searchsorted(kind >> 1, np.searchsorted(common, ends), "right") - 1].tolist()
    texts = [whole[start:stop - 1] for start, stop in zip([0, *stops], stops)]
    return texts, np.searchsorted(ends, steps), links, np.searchsorted(ends, common)


@dataclass
class Fragment:
    """What a byte range knows: tokens before its first common end, closed groups, tokens after its last common end.

    Without a common end (``cut``) all tokens are in ``left``. ``valid`` tells if both tokenizers give back the bytes.
    """

    cut: bool
    left: Open
    closed: Closed
    right: Open
    valid: bool = True

    @staticmethod
    def of(tokens: Open) -> Fragment:
        """Of the tokens that end in a byte range."""
        common = _merged(tokens.a_ends, tokens.b_ends)[1]
        if not len(common):
            return Fragment(False, tokens, Closed(), Open.none())
        first, last = int(common[0]), int(common[-1])
        return Fragment(True, tokens.cut(-1, first), tokens.cut(first, last).closed(), tokens.cut(last, 1 << 62))

    @staticmethod
    def start() -> Fragment:
        """The beginning of a text, which is a common end."""
        return Fragment(True, Open.none(), Closed(), Open.none())

    @staticmethod
    def joined(parts: list[Fragment]) -> Fragment:
        """The fragment of neighbouring byte ranges. Joining in any grouping gives the same."""
        valid = all(part.valid for part in parts)
        cut, left, right, closed = False, Open.none(), Open.none(), []
        for part in parts:
            if not cut:
                left, right, closed, cut = left + part.left, part.right, [part.closed], part.cut
            elif not part.cut:
                right = right + part.left
            else:
                closed += [(right + part.left).closed(), part.closed]
                right = part.right
        return Fragment(cut, left, Closed.joined(closed), right, valid)


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes`` values from each of ``starts`` on, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _inner(word: str) -> bool:
    """Whether a word begins and ends with something other than white space."""
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


class Aligner:
    """Encodes texts by both tokenizers, with the closed fragments of pieces met before."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokenizer.load(path_a), Tokenizer.load(path_b)
        self.forget()

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path_a: str, path_b: str) -> Aligner:
        return Aligner(path_a, path_b)

    def forget(self, most: int = 0) -> None:
        """Forget all pieces, or those used least, until the others have at most ``most`` characters."""
        kept, least = [], 2
        while most:
            kept = [(word, at) for word, at in self.known.items() if at >= 0 and self.uses[at] >= least]
            if sum(len(word) + 1 for word, _ in kept) <= most:
                break
            least *= 2
        at = np.array([at for _, at in kept], np.int64)
        old = (self.texts, self.counts, self.links, self.starts) if kept else ()
        self.held = sum(len(word) + 1 for word, _ in kept)
        self.known: dict[str, int] = {word: number for number, (word, _) in enumerate(kept)}
        self.texts: list[str] = [old[0][place] for place in at.tolist()]
        size = max(1024, 2 * len(at))
        self.counts, self.starts = np.zeros((size, 4), np.int32), np.zeros(size, np.int64)  # n_a, n_b, groups, links
        self.uses, self.links, self.used = np.zeros(size, np.int32), np.zeros(8 * size, np.int64), 0
        if kept:
            self._store(old[1][at], _gather(old[2], old[3][at], old[1][at, 3]), 0)

    def _store(self, counts: np.ndarray, links: np.ndarray, first: int) -> None:
        """Put the counts and links of new pieces behind those of the first ones."""
        end = first + len(counts)
        if end > len(self.counts):
            more = max(end, 2 * len(self.counts)) - len(self.counts)
            self.counts = np.concatenate([self.counts, np.zeros((more, 4), np.int32)])
            self.starts, self.uses = np.append(self.starts, np.zeros(more, np.int64)), np.append(self.uses, np.zeros(more, np.int32))
        if self.used + len(links) > len(self.links):
            self.links = np.append(self.links, np.zeros(max(len(links), len(self.links)), np.int64))
        self.counts[first:end] = counts
        self.starts[first:end] = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.links[self.used:self.used + len(links)] = links
        self.used += len(links)

    def tokens(self, piece: str) -> Open | None:
        """Of a text that begins with a blank; None if a tokenizer does not give back its bytes."""
        a = self.a.tokens(piece)
        b = a and self.b.tokens(piece)
        return Open(*a, *b) if b else None

    def _learn(self, words: list[str]) -> None:
        """Remember the closed fragments of words, each with a blank before it; -1 for those without valid tokens."""
        tokens = self.tokens(" " + " ".join(words))
        if tokens is None:
            if len(words) == 1:
                self.known[words[0]] = -1
            else:  # some word is not given back: look for it by halves
                self._learn(words[:len(words) // 2])
                self._learn(words[len(words) // 2:])
            return
        ends = np.cumsum([len(word.encode()) + 1 for word in words])
        texts, link_part, links, group_part = _aligned(tokens, ends)
        new, first = len(words), len(self.texts)
        counts = [np.searchsorted(ends, tokens.a_ends), np.searchsorted(ends, tokens.b_ends), group_part, link_part]
        self._store(np.stack([np.bincount(part, minlength=new) for part in counts], axis=1), links, first)
        self.texts += texts
        self.known.update(zip(words, range(first, first + new)))
        self.held += int(ends[-1])

    def closed(self, texts: list[list[str]]) -> list[Closed | None]:
        """The groups of lists of words, each with a blank before it, cut where a single blank stands between two other characters."""
        if self.held > REMEMBERED:
            self.forget(REMEMBERED // 2)
        found = [list(map(self.known.get, words)) for words in texts]
        if new := {word: None for words, places in zip(texts, found) if None in places for word, at in zip(words, places) if at is None}:
            # White space at an edge of a piece may merge with a neighbour's, so such pieces are encoded by themselves.
            if inner := [word for word in new if _inner(word)]:
                self._learn(inner)
            for word in new:
                if not _inner(word):
                    self._learn([word])
            found = [list(map(self.known.get, words)) if None in places else places for words, places in zip(texts, found)]
        out = [self._gathered(places) for places in found]
        for word in new:
            if len(word) > LONGEST or not _inner(word):  # a known word stands for one that may be cut out
                del self.known[word]
        return out

    def _gathered(self, found: list[int]) -> Closed | None:
        at = np.array(found, np.int64)
        if len(at) and at.min() < 0:
            return None
        self.uses[at] += 1
        counts = self.counts[at]
        n_a, n_b, groups, links = counts.sum(axis=0, dtype=np.int64).tolist()
        all_links = _gather(self.links, self.starts[at], counts[:, 3])
        return Closed(n_a, n_b, groups, ";".join(map(self.texts.__getitem__, found)), *_counted(all_links))

    def words(self, text: str) -> list[str]:
        """``text`` cut where a single blank stands between two characters other than white space."""
        words = text.split(" ")
        known = self.known
        if all(word in known or _inner(word) for word in words[1:-1]) and (
                len(words) == 1 or words[0] and not words[0][-1].isspace() and words[-1] and not words[-1][0].isspace()):
            return words
        out = [words[0]]
        for word in words[1:]:
            last = out[-1]
            if last and word and not last[-1].isspace() and not word[0].isspace():
                out.append(word)
            else:
                out[-1] = last + " " + word
        return out

    def fragment(self, text: str, low: int, high: int, offset: int = 0) -> Fragment:
        """Of the tokens of ``text``, which begins with a blank and stands at ``offset``, that end in the bytes after ``low`` up to ``high``."""
        words, size = self.words(text[1:]), len(text.encode()) + offset
        parts, at, valid = [], offset, True
        first = 0
        if low > offset:  # the range begins within the first piece
            tokens = self.tokens(" " + words[0])
            valid &= tokens is not None
            parts.append(Fragment.of((tokens or Open.none()).moved(at).cut(low, high)))
            at, first = at + len(words[0].encode()) + 1, 1
        last = len(words)
        if high < size and last > first:  # and ends within the last one
            last -= 1
        inner = words[first:last]
        closed, = self.closed([inner])
        valid &= closed is not None
        if inner:
            parts.append(Fragment(True, Open.none(), closed or Closed(), Open.none()))
        if last < len(words):
            at += sum(len(word.encode()) + 1 for word in inner)
            tokens = self.tokens(" " + words[last])
            valid &= tokens is not None
            parts.append(Fragment.of((tokens or Open.none()).moved(at).cut(low, high)))
        whole = Fragment.joined(parts)
        whole.valid = bool(valid)
        return whole


def ranges(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, int, int, int]]:
    """A text that begins with a blank in byte ranges of about ``chunk``: the pieces that a range touches, the offset of the first, and the
    range. Pieces reach from one single blank between two other characters to the next; a piece over several edges is cut at the first."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
    space = np.isin(codes, _SPACES)
    inside = np.flatnonzero((codes[1:-1] == 0x20) & ~space[:-2] & ~space[2:]) + 1
    pieces = np.concatenate([[0], inside, [len(codes)]])  # in characters
    offsets = starts[pieces]
    edges = np.arange(chunk, int(starts[-1]), chunk)
    _, first = np.unique(np.searchsorted(offsets, edges, "right"), return_index=True)
    kept = np.concatenate([[0], edges[first], starts[-1:]]).tolist()
    for low, high in zip(kept, kept[1:]):
        begin, end = int(np.searchsorted(offsets, low, "right")) - 1, int(np.searchsorted(offsets, high))
        yield text[pieces[begin]:pieces[end]], int(offsets[begin]), low, high


_OPEN = ["a", "a_ends", "b", "b_ends"]
_LONGS = pa.list_(pa.int64())
_FRAGMENT = pa.schema([
    ("row", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("doc_id", pa.string()), ("valid", pa.bool_()), ("cut", pa.bool_()),
    *[(f"left_{name}", _LONGS) for name in _OPEN], *[(f"right_{name}", _LONGS) for name in _OPEN],
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("pairs", _LONGS), ("times", _LONGS)])
_FRAGMENT_DDL = ", ".join(f"{entry.name} " + {"int64": "long", "bool": "boolean", "string": "string"}.get(str(entry.type), "array<long>")
                          for entry in _FRAGMENT)


def _as_row(fragment: Fragment, row: int, chunk: int, chunks: int, doc_id: str) -> dict:
    closed = fragment.closed
    return {"row": row, "chunk": chunk, "chunks": chunks, "doc_id": doc_id, "valid": fragment.valid, "cut": fragment.cut,
            **{f"left_{name}": part for name, part in zip(_OPEN, fragment.left.parts())},
            **{f"right_{name}": part for name, part in zip(_OPEN, fragment.right.parts())},
            "n_a": closed.n_a, "n_b": closed.n_b, "n_groups": closed.n_groups, "groups": closed.text,
            "pairs": closed.pairs, "times": closed.times}


def _from_row(row: dict) -> Fragment:
    left, right = (Open(*[np.array(row[f"{side}_{name}"], np.int64) for name in _OPEN]) for side in ("left", "right"))
    closed = Closed(row["n_a"], row["n_b"], row["n_groups"], row["groups"], np.array(row["pairs"], np.int64), np.array(row["times"], np.int64))
    return Fragment(row["cut"], left, closed, right, row["valid"])


def _rows(batch: pa.RecordBatch, step: int = 64) -> Iterator[dict]:
    for start in range(0, batch.num_rows, step):
        yield from batch.slice(start, step).to_pylist()


_DONE = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
                   ("pairs", _LONGS), ("times", _LONGS)])
_DONE_DDL = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _done(fragment: Fragment, digest: bool) -> dict:
    """The result for a whole text."""
    whole = Fragment.joined([Fragment.start(), fragment]).closed if fragment.valid else Closed()
    groups = hashlib.sha256(whole.text.encode()).hexdigest() if digest and whole.n_groups else whole.text
    return {"n_a": whole.n_a, "n_b": whole.n_b, "n_groups": whole.n_groups, "n_links": int(whole.times.sum()), "groups": groups,
            "pairs": whole.pairs, "times": whole.times}


def _whole_texts(docs: DataFrame, a: str, b: str, digest: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.load(a, b)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [text or "" for text in batch.column("text").to_pylist()]
                words = [aligner.words(text) if text else [] for text in texts]
                rows = [_done(Fragment(True, Open.none(), closed or Closed(), Open.none(), closed is not None), digest)
                        for closed in aligner.closed(words)]
                made = pa.RecordBatch.from_pylist(rows, _DONE)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], ["doc_id", *_DONE.names])

    return docs.mapInArrow(aligned, f"doc_id {kind}, {_DONE_DDL}")


def _long_texts(docs: DataFrame, a: str, b: str, digest: bool, chunk: int) -> DataFrame:
    """The same for long texts: byte ranges in tasks of their own, put together in a tree."""
    kind = docs.schema["doc_id"].dataType
    cut_schema = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("doc_id", pa.string()), ("text", pa.string()),
                            ("low", pa.int64()), ("high", pa.int64()), ("start", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch, 1):
                found = list(ranges(" " + row["text"], chunk))
                yield pa.RecordBatch.from_pylist([
                    {"row": row["row"], "chunk": number, "chunks": len(found), "doc_id": row["doc_id"], "text": text, "low": low,
                     "high": high, "start": offset} for number, (text, offset, low, high) in enumerate(found)], cut_schema)

    done_schema = pa.schema([("doc_id", pa.string()), *_DONE])

    def put(made: Fragment, row: int, number: int, count: int, key: str, last: bool) -> pa.RecordBatch:
        if last:
            return pa.RecordBatch.from_pylist([_done(made, digest) | {"doc_id": key}], done_schema)
        return pa.RecordBatch.from_pylist([_as_row(made, row, number, count, key)], _FRAGMENT)

    # The last step gives results itself: a step of its own in the same tasks would double the Python workers and what they remember.
    def fragments(last: bool):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = Aligner.load(a, b)
            for batch in batches:
                for row in _rows(batch, 16):
                    own = aligner.fragment(row["text"], row["low"], row["high"], row["start"])
                    yield put(own, row["row"], row["chunk"], row["chunks"], row["doc_id"], last)

        return made

    def joined(last: bool):
        def put_all(rows: list[dict]) -> pa.RecordBatch:
            first = rows[0]
            own = Fragment.joined([_from_row(row) for row in rows])
            return put(own, first["row"], first["chunk"] // FAN, -(-first["chunks"] // FAN), first["doc_id"], last)

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, held = None, []
            for batch in batches:
                for row in _rows(batch, FAN):
                    if (key := (row["row"], row["chunk"] // FAN)) != own:
                        if held:
                            yield put_all(held)
                        own, held = key, []
                    held.append(row)
            if held:
                yield put_all(held)

        return made

    # Stored, so that the numbers of the rows stay the same in every later attempt.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    cuts = materialise(rows.mapInArrow(cut, "row long, chunk long, chunks long, doc_id string, text string, low long, high long, start long"), "align-ranges")
    most = cuts.agg(F.max("chunks")).first()[0] or 1
    results = f"doc_id string, {_DONE_DDL}"
    made = cuts.repartition("row", "chunk").mapInArrow(fragments(most == 1), results if most == 1 else _FRAGMENT_DDL)
    while most > 1:
        near, most = made.repartition("row", F.floor(F.col("chunk") / FAN)).sortWithinPartitions("row", "chunk"), -(-most // FAN)
        made = near.mapInArrow(joined(most == 1), results if most == 1 else _FRAGMENT_DDL)
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def align(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (or with ``digest`` its SHA-256), and the distinct id pairs of the
    links, as ``pairs`` (first id in the upper 32 bits) and ``times``, for the tokenizer files ``a`` and ``b``."""
    docs = df.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    return _whole_texts(docs.where(~long), a, b, digest).unionByName(_long_texts(docs.where(long), a, b, digest, chunk))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``links`` (of all texts), ``best`` (no pair with its second id has more)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.times").alias("links"))
    each = materialise(each.withColumn("second", F.col("pair").bitwiseAND((1 << SHIFT) - 1)), "align-counts")
    highest = each.groupBy("second").agg(F.max("links").alias("highest"))
    return each.join(highest, "second").select("pair", "links", (F.col("links") == F.col("highest")).alias("best"))


def translation(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = True, chunk: int = CHUNK,
                heavy: int = HEAVY) -> DataFrame:
    """``align`` with ``n_best`` (links whose pair is its second id's most frequent) and ``count_sum`` (over links, links of their pair)."""
    rows = align(df, a, b, doc_id, text, digest, chunk).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "align-rows")
    counts = materialise(pair_counts(rows), "align-pairs")
    total = counts.agg(F.sum("links")).first()[0] or 0
    frequent = F.col("links") * heavy >= total  # at most ``heavy`` pairs
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    marked = each.join(F.broadcast(counts.where(frequent)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum")]
    known = marked.where("links is not null").groupBy("row").agg(*sums)
    rare = marked.where("links is null").drop("links", "best").join(counts.where(~frequent), "pair").groupBy("row").agg(*sums)
    both = known.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(both, "row", "left").withColumns({
        "n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)}).drop("row")
