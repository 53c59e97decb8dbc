"""Main text of pages, with a suffix array per host.

A page is cut into blocks. Scripts, styles and the head are never text; navigation, forms, asides, footers and elements whose class,
id or role says so (menu, sidebar, advert, notice, comments and the like) are furniture. In a marked article or main element, text
in paragraphs, headings, list items, cells and quotes, or in no element of its own, is prose; text that lies directly in a division
or section with attributes, as adverts and teasers do, is a box. What is left outside articles is open.

All words of all pages of a host are concatenated: of each page those outside prose, then every block of prose by itself. All suffixes
are sorted by their first ``RUN`` words, and a run that starts suffixes outside prose on ``PAGES`` or more distinct pages is boilerplate.
Boxes that such runs cover wholly go, and so do open blocks of pages without prose or boxes if covered for ``COVERED`` or more of their
words; unique ones are main text. A run is standing text if more than half of the host's distinct pages, and ``PAGES`` or more, hold it
twice: outside prose and in a block of prose that begins like something outside. Prose goes if standing runs that its page holds outside
too cover it wholly: a notice that a template prints into the article as well. All other prose stays, however often a host repeats
it: articles quote and share sentences, also those of adverts and footers, and their titles stand in menus.

Defined results: null or empty html, or no main text, gives an empty text; a null url belongs to the host ''; markup that is cut off
ends where the page ends; a tag with an unclosed quote ends at the next '>'; pages of equal visible text count as one page, and every
one of them gets its text; an empty table gives an empty result. Extra columns are ignored.

Scale: the visible blocks of a page, compressed, go through one exchange to the array of their host, whose task writes the texts. No
text is stored before, so the pages of large hosts are parsed twice, and must be the same each time. A host of more than ``LETTERS`` *
``TOKENS`` characters of markup is cut into several arrays by page; the pages they count for each run outside prose are added up over
all arrays of the host and the repeated ones sent back, so the cut changes no result. That count gets the blocks outside prose and those
that begin like them. A task holds one array at a time, and copies of a page stream past it. Hosts that are cut are broadcast, one row for
16 MB of markup at least.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import quoted
from rillmark.session import materialise

RUN = 8
#: A run is boilerplate on this many distinct pages of a host, however large the host.
PAGES = 3
COVERED = 0.5
#: Words of an array, and characters of markup taken for one.
TOKENS, LETTERS = 2_000_000, 8
#: Pages whose copies a task knows again.
COPIES = 100_000

# Quotes delimit a value only after an equals sign; one that is not closed is a character like others.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z].*""",
                  re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_BLANK = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

#: Elements whose content is not text; of these only head and title end a block.
RAW = frozenset("script style title textarea noscript template iframe svg head select datalist annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label maction mark math menclose "
                   "merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup "
                   "msup mtext munder munderover object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var video "
                   "wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Furniture by element; an article inside it is furniture too.
FURNITURE = frozenset("nav aside footer form button dialog menu".split())
#: Furniture by a word of the class, id or role. What follows an article or stands for others' texts; an article inside is one too.
FOREIGN = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended recommendations nav navbar "
                    "navigation menu breadcrumb breadcrumbs".split())
MARKED = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar footer cookie "
                   "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
                   "sharing social widget toolbar pagination pager search copyright contentinfo complementary".split())
#: Elements that an id may mark, since ids of headings and paragraphs are made from their words. Inside an article only an id made of
#: nothing but the second list does.
CONTAINERS = frozenset("div section ul ol table".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond nav navbar navigation menu breadcrumb breadcrumbs".split())
#: Elements whose text is prose in an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre address summary".split())
#: Furniture only outside an article, where it may hold the title.
HEADERS = frozenset("header masthead".split())
#: An element of these ends an open one of the same kind.
_IMPLIED = frozenset("p li dt dd tr td th option".split())

_MAIN, _OPEN, _SOFT, _HARD = range(4)
#: What a block is.
IN_PROSE, IN_BOX, IS_OPEN, IS_FURNITURE = range(4)


def _zone(name: str, attributes: str, outer: int) -> int:
    """The zone inside an element, given that of its parent."""
    if outer == _HARD or name in FURNITURE:
        return _HARD
    words: set[str] = set()
    if attributes.strip():
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "role") and name not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                words.update(word.lower() for word in _NAME.findall(value))
            elif key == "id" and name in CONTAINERS:
                marks = {word.lower() for word in _NAME.findall(value)}
                words |= marks if outer != _MAIN or marks <= COMMENTS else set()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return _HARD
    if name in ("html", "body"):
        return outer
    if words & FOREIGN:
        return _HARD
    if name in ("article", "main") or "main" in words and outer != _SOFT and name in ("div", "section"):
        return _MAIN
    if words & MARKED or outer != _MAIN and (name == "header" or words & HEADERS):
        return _SOFT
    return outer


def visible(html: str | None) -> list[tuple[int, str]]:
    """All visible blocks of a page in order, each with what it is."""
    html, found = html or "", []
    stack: list[tuple[str, int, bool]] = []
    zone, boxed, prose, parts, at = _OPEN, False, False, [], 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            inside = IN_BOX if boxed and not prose else IN_PROSE
            found.append((inside if zone == _MAIN else IS_OPEN if zone == _OPEN else IS_FURNITURE, text))

    while (tag := _TAG.search(html, at)) is not None:
        if tag.start() > at:
            parts.append(html[at:tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:  # a comment, a declaration, or a tag that is cut off
            continue
        name = name.lower()
        if name in RAW and not tag[1]:
            if name in ("head", "title"):
                flush()
            elif name in ("svg", "iframe"):
                parts.append(" ")
            if not tag[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
                if end is None and name == "head":  # its end tag may be left out
                    end = re.compile(r"(?=<body\b)", re.IGNORECASE).search(html, at)
                at = len(html) if end is None else end.end()
            continue
        if name in INLINE and not (tag[3] and not tag[1] and name not in VOID and _zone(name, tag[3], zone) != zone):
            if name in ("br", "wbr", "img"):
                parts.append(" ")
            if not (tag[1] and any(name == own for own, _, _ in stack)):
                continue
        flush()
        if name in PROSE:
            prose = not tag[1]
        elif name not in INLINE:
            prose = False
        if tag[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    _, zone, boxed = stack[depth]
                    del stack[depth:]
                    break
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        if stack and stack[-1][0] in _IMPLIED and (stack[-1][0] == name or stack[-1][0] == "p" and name not in INLINE):
            _, zone, boxed = stack.pop()
        inner = _zone(name, tag[3], zone)
        if inner != zone or name in ("div", "section", "article", "main", "ul", "ol", "table", "header"):
            stack.append((name, zone, boxed))
            boxed = zone == inner == _MAIN and (name in ("div", "section") and "=" in tag[3] or boxed and name in PROSE)
            zone = inner
    if at < len(html):
        parts.append(html[at:])
    flush()
    return found


def blocks(html: str | None) -> tuple[list[str], list[tuple[bool, str]]]:
    """Blocks of the marked article, and (open, block) for all other visible blocks, in page order."""
    found = visible(html)
    return ([text for kind, text in found if kind in (IN_PROSE, IN_BOX)],
            [(kind == IS_OPEN, text) for kind, text in found if kind in (IS_OPEN, IS_FURNITURE)])


def host_of(url: Column) -> Column:
    bare = F.regexp_replace(url, rf"^{_BLANK}+|{_BLANK}+\z", "")
    return F.coalesce(F.lower(F.regexp_extract(bare, _HOST, 1)), F.lit(""))


def parse(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_row``, ``page_id``, ``url``, ``html`` and ``host``. Blocks are cut where the arrays need them; nothing is stored or decided here."""
    return pages.select(F.monotonically_increasing_id().alias("page_row"), quoted(page_id).cast("long").alias("page_id"),
                        quoted(url).cast("string").alias("url"), quoted(html).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))


_ZSTD = pa.Codec("zstd")


def _pack(found: list[tuple[int, str]]) -> bytes:
    plain = json.dumps(found, ensure_ascii=False).encode("utf-8", "surrogatepass")
    return len(plain).to_bytes(4, "big") + _ZSTD.compress(plain, asbytes=True)


def _unpack(packed: bytes) -> list[tuple[int, str]]:
    plain = _ZSTD.decompress(packed[4:], int.from_bytes(packed[:4], "big"), asbytes=True)
    return [(kind, block) for kind, block in json.loads(plain.decode("utf-8", "surrogatepass"))]


def _echoes(found: list[tuple[int, str]]) -> list[bool]:
    """For each block, whether it is prose whose first run is found outside prose on the same page. No other prose can be covered wholly."""
    outside = f" {' '.join(block for kind, block in found if kind != IN_PROSE)} "
    starts = (block.split(" ", RUN)[:RUN] if kind == IN_PROSE else [] for kind, block in found)
    return [len(start) == RUN and f" {' '.join(start)} " in outside for start in starts]


def _blocks(pages: DataFrame, whole: bool) -> DataFrame:
    """The pages with ``part``, ``content`` (a digest of the visible text), ``marked`` (prose and no boxes) and ``packed``: all visible blocks, or
    those outside prose and their echoes; null for most copies of a page."""
    schema = pa.schema([("content", pa.binary()), ("marked", pa.bool_()), ("packed", pa.binary())])
    names = ["page_row", "page_id", "url", "host", "arrays"]

    def page(host: str, html: str | None, met: set[tuple[str, bytes]]) -> dict:
        found = visible(html)
        content = hashlib.blake2b("\n".join(f"{kind} {block}" for kind, block in found).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        kinds = {kind for kind, _ in found}
        packed = None
        if (host, content) not in met:
            if len(met) >= COPIES:
                met.clear()
            met.add((host, content))
            packed = _pack(found if whole else [one for one, echo in zip(found, _echoes(found)) if echo or one[0] != IN_PROSE])
        return {"content": content, "marked": IN_PROSE in kinds and IN_BOX not in kinds, "packed": packed}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, bytes]] = set()
        for large in batches:
            for start in range(0, large.num_rows, 512):
                batch = large.slice(start, 512)
                rows = [page(*one, met) for one in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())]
                made = pa.RecordBatch.from_pylist(rows, schema)
                yield pa.RecordBatch.from_arrays([batch.column(name) for name in names] + made.columns, [*names, *schema.names])

    made = pages.mapInArrow(cut, "page_row long, page_id long, url string, host string, arrays int, content binary, marked boolean, packed binary")
    return made.withColumn("part", F.pmod(F.xxhash64("content"), F.col("arrays")).cast("int"))


class SuffixArray:
    """Suffixes of several sequences of numbered words in order of their first ``run`` words.

    They are ranked by prefix doubling; suffixes of one rank are neighbours and start with the same run. A sequence belongs to a page,
    by default one of its own. Sequences of a page follow each other, those ``outside`` prose first; ``echoes`` are others that may repeat them.
    """

    def __init__(self, tokens: np.ndarray, sizes: list[int], run: int = RUN, owners: list[int] | None = None, outside: list[bool] | None = None,
                 echoes: list[bool] | None = None):
        self.tokens, self.run, self.ends = tokens, run, np.cumsum(np.array(sizes, np.int64), dtype=np.int32)
        sequence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        suffixes, rank = self._sorted(sequence)
        full = suffixes + run <= self.ends[sequence[suffixes]] if len(sizes) else suffixes < 0
        #: Places of the suffixes of full length, and the number of each one's run.
        self.suffixes = suffixes[full]
        changes = _changes(rank[self.suffixes])
        self.runs = np.cumsum(changes, dtype=np.int32) - 1
        self.first = self.suffixes[changes]
        # Suffixes of a run are in order of place, so of page, and those outside prose come first.
        own = sequence[self.suffixes]
        pages = own if owners is None else np.array(owners, np.int32)[own]
        self.outside = np.ones(len(own), bool) if outside is None else np.array(outside, bool)[own]
        starts = changes | _changes(pages)
        group = np.cumsum(starts, dtype=np.int32) - 1
        held = self.outside[starts]
        #: Suffixes of echoes whose page holds the run outside as well.
        self.echoed = held[group] & (np.zeros(len(own), bool) if echoes is None else np.array(echoes, bool)[own])
        twice = np.bincount(group[self.echoed], minlength=len(held)) > 0
        #: On how many pages each run is outside prose, and on how many also in an echo.
        self.pages = np.bincount(self.runs[starts][held], minlength=len(self.first))
        self.twice = np.bincount(self.runs[starts][twice], minlength=len(self.first))

    def _sorted(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and for each place how many suffixes come before those that start alike."""
        size = len(self.tokens)
        counts = np.bincount(self.tokens)
        rank = (np.cumsum(counts) - counts).astype(np.int32)[self.tokens]
        tied = np.flatnonzero(counts[self.tokens] > 1).astype(np.int32)
        depth = 1
        while depth < self.run and len(tied):
            step = min(depth, self.run - depth)
            after = np.minimum(tied + step, size - 1)
            inside = (tied + step < size) & (sequence[after] == sequence[tied])  # runs do not reach over the end of a sequence
            keys = rank[tied].astype(np.int64) * (size + 1)
            keys += np.where(inside, rank[after] + 1, 0)
            del after, inside
            order = np.argsort(keys)
            tied, changes = tied[order], _changes(keys[order])
            del keys, order
            old = rank[tied]
            rank[tied] = old + _starts(changes) - _starts(_changes(old))
            tied = np.sort(tied[~changes | ~np.append(changes[1:], True)])  # those alike to the one before or after them
            depth += step
        suffixes = np.empty(size, np.int32)
        suffixes[rank] = np.arange(size, dtype=np.int32)
        tied = tied[np.argsort(rank[tied], kind="stable")]
        suffixes[rank[tied] + np.arange(len(tied), dtype=np.int32) - _starts(_changes(rank[tied]))] = tied
        return suffixes, rank

    def digests(self, wanted: np.ndarray, words: list[str]) -> list[bytes]:
        """A digest of each wanted run, the same in every array; ``words`` by number."""
        runs = (" ".join([words[token] for token in self.tokens[at:at + self.run].tolist()]) for at in self.first[wanted].tolist())
        return [hashlib.blake2b(run.encode("utf-8", "surrogatepass"), digest_size=16).digest() for run in runs]

    def covered(self, often: np.ndarray, standing: np.ndarray | None = None) -> np.ndarray:
        """For each place, whether it lies in a run that is frequent, or in an echo in one that is standing text."""
        marked = self.outside & often[self.runs]
        if standing is not None:
            marked |= self.echoed & standing[self.runs]
        starts, size = self.suffixes[marked], len(self.tokens) + 1
        return np.cumsum(np.bincount(starts, minlength=size) - np.bincount(starts + self.run, minlength=size))[:-1] > 0


def _changes(values: np.ndarray) -> np.ndarray:
    """Which values differ from the one before."""
    changes = np.ones(len(values), bool)
    changes[1:] = values[1:] != values[:-1]
    return changes


def _starts(changes: np.ndarray) -> np.ndarray:
    """For each place, that of the last change."""
    return np.maximum.accumulate(np.where(changes, np.arange(len(changes), dtype=np.int32), np.int32(0)))


def repeated(pages: list[list[str]], run: int = RUN, least: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, which lie in runs of ``run`` tokens found on ``least`` or more of the pages."""
    numbers: dict[str, int] = {}
    tokens = np.array([numbers.setdefault(token, len(numbers)) for page in pages for token in page], np.int32)
    array = SuffixArray(tokens, [len(page) for page in pages], run)
    return np.split(array.covered(array.pages >= least), array.ends[:-1]) if pages else []


class _Host:
    """The pages of one array."""

    def __init__(self) -> None:
        self.pages: dict[bytes, list[tuple[int, str]]] = {}
        #: Runs that all arrays of a host that is cut found on enough pages, and which of them are standing text.
        self.runs: dict[bytes, bool] = {}

    def add(self, content: bytes, packed: bytes) -> None:
        if content not in self.pages:
            self.pages[content] = _unpack(packed)

    def build(self) -> SuffixArray:
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        number = numbers.__getitem__
        chunks, sizes, owners, outside, echoes = [], [], [], [], []
        for at, found in enumerate(self.pages.values()):
            tokens = [number(word) for kind, block in found if kind != IN_PROSE for word in block.split()]
            sizes.append(len(tokens))
            outside.append(True)
            echoes.append(False)
            for (kind, block), echo in zip(found, _echoes(found)):
                if kind == IN_PROSE:
                    before = len(tokens)
                    tokens.extend(map(number, block.split()))
                    sizes.append(len(tokens) - before)
                    outside.append(False)
                    echoes.append(echo)
            chunks.append(np.array(tokens, np.int32))
            owners.extend([at] * (len(sizes) - len(owners)))
        self.array = SuffixArray(np.concatenate(chunks) if chunks else np.empty(0, np.int32), sizes, RUN, owners, outside, echoes)
        self.words = list(numbers)
        return self.array

    def counts(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Digests of the runs outside prose, on how many pages each is there, and on how many twice."""
        array = self.build()
        outside = array.pages > 0
        return array.digests(outside, self.words), array.pages[outside], array.twice[outside]

    def texts(self, cut: bool) -> dict[bytes, str]:
        """The main text of each page."""
        array = self.build()
        if cut:
            outside = array.pages > 0
            verdicts = [self.runs.get(run) for run in array.digests(outside, self.words)]
            often, standing = np.zeros(len(outside), bool), np.zeros(len(outside), bool)
            often[outside] = [verdict is not None for verdict in verdicts]
            standing[outside] = [verdict is True for verdict in verdicts]
        else:
            often, standing = array.pages >= PAGES, (array.twice >= PAGES) & (2 * array.twice > len(self.pages))
        marks, texts, at = array.covered(often, standing), {}, 0
        for content, found in self.pages.items():
            size = sum(block.count(" ") + 1 for _, block in found)
            texts[content] = _unique(found, marks[at:at + size])
            at += size
        return texts


def _unique(found: list[tuple[int, str]], marks: np.ndarray) -> str:
    """The blocks that stay: prose and boxes not wholly covered, and without either the open blocks that are mostly unique."""
    marked = any(kind in (IN_PROSE, IN_BOX) for kind, _ in found)
    sizes = [block.count(" ") + 1 for _, block in found]
    kept, at, prose = [], 0, sum(size for (kind, _), size in zip(found, sizes) if kind != IN_PROSE)
    plain = not marks[prose:].any()
    for (kind, block), size in zip(found, sizes):
        if kind == IN_PROSE:
            if plain or not marks[prose:prose + size].all():
                kept.append(block)
            prose += size
            continue
        own = marks[at:at + size]
        if kind == IN_BOX and not own.all() or kind == IS_OPEN and not marked and own.mean() < COVERED:
            kept.append(block)
        at += size
    return "\n".join(kept)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of host and part: the counts of each array's runs; those of the empty run are all its pages."""
    schema = pa.schema([("host", pa.string()), ("part", pa.int32()), ("run", pa.binary()), ("pages", pa.int64()), ("twice", pa.int64())])

    def counted(name: str, part: int, host: _Host) -> pa.RecordBatch:
        runs, pages, twice = host.counts()
        size = len(runs) + 1
        return pa.RecordBatch.from_pydict({"host": [name] * size, "part": [part] * size, "run": [*runs, b""], "pages": [*pages.tolist(), len(host.pages)],
                                           "twice": [*twice.tolist(), 0]}, schema)

    own, host = None, _Host()
    for batch in batches:
        for name, part, content, packed in zip(*(batch.column(column).to_pylist() for column in ("host", "part", "content", "packed"))):
            if (name, part) != own:
                if own is not None:
                    yield counted(*own, host)
                own, host = (name, part), _Host()
            host.add(content, packed)
    if own is not None:
        yield counted(*own, host)


_ROW = ("host", "part", "step", "run", "standing", "content", "packed", "page_row", "page_id", "url", "marked")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of host, part and step: each array's runs and contents, then its pages, which get their texts as they stream by."""
    schema = pa.schema([("page_row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("marked", pa.bool_()), ("text", pa.string())])
    own, host, texts, rows = None, None, None, []
    for batch in (whole.slice(start, 512) for whole in batches for start in range(0, whole.num_rows, 512)):
        for name, part, step, run, standing, content, packed, *page in zip(*(batch.column(column).to_pylist() for column in _ROW)):
            if (name, part) != own:
                own, host, texts = (name, part), _Host(), None
            if run is not None:
                host.runs[run] = standing
            elif step == 0:
                host.add(content, packed)
            else:
                if texts is None:
                    texts, host = host.texts(part is not None), None
                rows.append(dict(zip(schema.names, (*page, texts[content]))))
                if len(rows) == 512:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def decide(parsed: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """``page_row``, ``page_id``, ``url``, ``marked``, ``text`` of all pages, as the arrays of their host decide."""
    letters = F.sum(F.coalesce(F.length("html"), F.lit(0)))
    large = materialise(parsed.groupBy("host").agg(F.ceil(letters / (LETTERS * tokens)).cast("int").alias("arrays")).where(F.col("arrays") > 1), "large")
    dealt = parsed.join(F.broadcast(large), "host", "left")

    def arrays(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition("host", "part").sortWithinPartitions("host", "part", *order)

    # Pages of equal visible text are one page: its blocks come first, then every copy.
    rows = _blocks(dealt, True).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).where(
        (F.col("step") == 1) | F.col("packed").isNotNull()).withColumn("packed", F.when(F.col("step") == 0, F.col("packed")))
    rows = rows.withColumns({"run": F.lit(None).cast("binary"), "standing": F.lit(None).cast("boolean")}).select(*_ROW)
    if not large.isEmpty():
        counted = arrays(_blocks(dealt.where(F.col("arrays").isNotNull()), False).where(F.col("packed").isNotNull())
                         .select("host", "part", "content", "packed")).mapInArrow(_count_runs, "host string, part int, run binary, pages long, twice long")
        often = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.sum("twice").alias("twice"), F.collect_set("part").alias("parts"))
        often = materialise(often.where((F.col("pages") >= PAGES) | (F.length("run") == 0)), "often")
        sizes = often.where(F.length("run") == 0).select("host", F.col("pages").alias("size"))
        sent = often.where(F.length("run") > 0).join(F.broadcast(sizes), "host").select(
            "host", F.explode("parts").alias("part"), F.lit(0).alias("step"), "run",
            ((F.col("twice") >= PAGES) & (2 * F.col("twice") > F.col("size"))).alias("standing"))
        rows = rows.unionByName(sent, allowMissingColumns=True)
    return arrays(rows.select(*_ROW), "step").mapInArrow(_decide, "page_row long, page_id long, url string, marked boolean, text string")


def unmarked(parsed: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """``page_row``, ``page_id``, ``url``, ``unique_text`` of the pages without prose and those with boxes."""
    return decide(parsed, tokens).where(~F.col("marked")).select("page_row", "page_id", "url", F.col("text").alias("unique_text"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``: blocks of the main text, in page order, a line each."""
    return decide(parse(pages, page_id, url, html)).select("page_id", "url", "text")
