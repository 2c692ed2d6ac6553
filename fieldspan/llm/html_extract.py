"""Main text of web pages by nearest-URL page differencing, with the pages' own marks as guard.

Each page's blocks are its lines. Pages are ordered by host, then URL path; a page's nearest is the
one before it on its host (for the first, the one after). The longest common subsequence aligns the
two pages' lines, and shared lines go. Alone this can't give right results: copied articles share
all lines, and an advert may be on one page only. So every page is differenced, and its marks then
restore or veto lines: those in an ``article`` or ``main`` element stay though shared; those in a
menu, header, footer, sidebar, form, notice, advert or comment part go though not shared. All other
lines stay if not shared; and, on a page without marked main text, also if the two pages are copies
(four fifths of those lines shared).

Null html is an empty page with an empty text. Pages without a host are a host of their own, and
the same URL may come often: then page_id orders. No page is dropped. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldspan.llm.shared import shuffle_width, small_batches

COPY = 0.8
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg textarea iframe select title head object canvas".split())
_OUT = frozenset("nav footer aside form button dialog menu".split())
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|comments?|commentlist|respond|cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommend\w*|pagination|pager|widget|skip-link)(?=$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=\s|/|$)""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_SPACE = re.compile(r"\s+")


def _marked_out(tag: str, attrs: str) -> bool:
    if tag in _OUT:
        return True
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and _HINT.search(value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """(line, kind) in page order; kind 1: marked as main text, -1: marked as other, 0: neither.

    Open elements are a stack; an end tag closes up to its start tag, and a stray one nothing. A
    ``header`` outside main text is a page's header, inside it the article's heading.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    kind = at = 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, kind))

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        if lt > at:
            held.append(page[at:lt])
        m = _TOKEN.match(page, lt)
        if m is None:
            held.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3]
        if tag == "br":
            held.append(" ")
            continue
        if tag in _RAW and not closing and tag != "head":
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    kind = stack[k][1]
                    del stack[k:]
                    break
            continue
        if tag == "p" or tag == "li":  # an open one of its kind ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    kind = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        stack.append((tag, kind))
        if kind >= 0 and tag not in ("body", "html") and (_marked_out(tag, attrs) or tag == "header" and kind == 0):
            kind = -1
        elif kind == 0 and tag in _MAIN:
            kind = 1
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of the lines of ``a`` and ``b``.

    Lines that the other page lacks are left out first, equal ends are matched at once. A row of the
    table is an integer: bit k is set where the length grows with the line k places before the end
    of ``b``. Every so many rows one is kept, and the rows between are made again on the way back,
    so memory grows with rows times the root of their number.
    """
    both = set(a) & set(b)
    ia, ib = [i for i, x in enumerate(a) if x in both], [j for j, y in enumerate(b) if y in both]
    found: set[int] = set()
    lo, ha, hb = 0, len(ia), len(ib)
    while lo < min(ha, hb) and a[ia[lo]] == b[ib[lo]]:
        found.add(ia[lo])
        lo += 1
    while ha > lo and hb > lo and a[ia[ha - 1]] == b[ib[hb - 1]]:
        ha, hb = ha - 1, hb - 1
        found.add(ia[ha])
    ia, ib = ia[lo:ha], ib[lo:hb]
    if not ia or not ib:
        return found
    n, m = len(ia), len(ib)
    full = (1 << m) - 1
    places: dict[str, list[int]] = {}
    for k, j in enumerate(reversed(ib)):
        places.setdefault(b[j], []).append(k)
    often: dict[str, int] = {}

    def marks(line: str) -> int:
        at = places.get(line)
        if at is None:
            return 0
        if line in often:
            return often[line]
        bits = bytearray(m // 8 + 1)
        for k in at:
            bits[k >> 3] |= 1 << (k & 7)
        made = int.from_bytes(bits, "little")
        if len(at) > 64:
            often[line] = made
        return made

    def above(row: int, i: int) -> int:
        v = row ^ full
        hit = v & marks(a[ia[i]])
        return (((v + hit) | (v - hit)) & full) ^ full

    step = isqrt(n) + 1
    kept, row = {n: 0}, 0
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def row_of(i: int) -> int:
        if i not in rows:
            top = min(n, (i // step + 1) * step)
            rows.clear()
            rows[top] = kept[top]
            for k in range(top - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], k)
        return rows[i]

    i = j = 0
    while i < n and j < m:
        if a[ia[i]] == b[ib[j]]:
            found.add(ia[i])
            i, j = i + 1, j + 1
            continue
        own, below = row_of(i), row_of(i + 1)
        # the longest of a[i:], b[j + 1:] and of a[i + 1:], b[j:]
        if (below & ((1 << (m - j)) - 1)).bit_count() >= (own & ((1 << (m - j - 1)) - 1)).bit_count():
            i += 1
        else:
            j += 1
    return found


def main_text(page: list[tuple[str, int]], near: list[str] | None) -> str:
    """The page's lines that stay, given the nearest page's lines."""
    shared = common([x for x, _ in page], near) if near else set()
    if not any(kind == 1 for _, kind in page):
        size = lambda places: sum(len(page[i][0]) for i in places if page[i][1] == 0)
        if size(shared) >= COPY * size(range(len(page))):
            shared = set()
    return "\n".join(x for i, (x, kind) in enumerate(page) if kind == 1 or kind == 0 and i not in shared)


_KEY = "host string, path string, page_id long, url string, digest long"
_ROW = f"part int, {_KEY}, again boolean, lines array<string>, kinds array<int>"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _place(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def _order(host: str, path: str, page_id: int | None, url: str | None, digest: int) -> tuple:
    """Sorts as Spark sorts the key: nulls come first."""
    return host, path, page_id is not None, page_id or 0, url is not None, url or "", digest


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """(host, path, page_id, url, digest) of the rows."""
    urls = batch.column("url").to_pylist()
    return [(*_place(u), p, u, d) for u, p, d in zip(urls, batch.column("page_id").to_pylist(), batch.column("digest").to_pylist())]


def _bounds(pages: DataFrame, parts: int) -> list[tuple]:
    """Keys that cut the pages into at most so many ranges, from a sample of 20 a range."""
    if parts < 2:
        return []
    sample = pages.select("page_id", "url", "digest").orderBy(F.xxhash64("page_id", "url", "digest")).limit(20 * parts).collect()
    keys = sorted({_order(*_place(r.url), r.page_id, r.url, r.digest) for r in sample})
    return sorted({keys[k * len(keys) // parts] for k in range(1, parts)}) if keys else []


def _edges(pages: DataFrame, bounds: list[tuple]) -> dict[tuple, list[int]]:
    """By the key of a range's first or last page: the ranges beside it that must see that page too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, tuple[tuple, tuple]] = {}
        for batch in batches:
            for key in _keys(batch):
                k, order = bisect_right(bounds, _order(*key)), _order(*key)
                lo, hi = ends.get(k, (key, key))
                ends[k] = key if order < _order(*lo) else lo, key if order > _order(*hi) else hi
        if ends:
            kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.int64())])
            named = [[dict(zip((f.name for f in kind), e[x])) for e in ends.values()] for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.int32()), pa.array(named[0], kind), pa.array(named[1], kind)], ["part", "lo", "hi"])

    kind = "struct<" + ", ".join(x.replace(" ", ": ") for x in _KEY.split(", ")) + ">"
    found = pages.select("page_id", "url", "digest").mapInArrow(run, f"part int, lo {kind}, hi {kind}")
    ends = sorted((r[0], r[1], r[2]) for r in found.groupBy("part").agg(F.min("lo"), F.max("hi")).collect()) if bounds else []
    out: dict[tuple, list[int]] = {}
    for (k, _, hi), (j, lo, _) in zip(ends, ends[1:]):
        if hi[0] == lo[0]:
            out.setdefault(_order(*hi), []).append(j)
            out.setdefault(_order(*lo), []).append(k)
    return out


def _parsed(pages: DataFrame, bounds: list[tuple], edges: dict[tuple, list[int]]) -> DataFrame:
    """The pages by range; edge pages stand again, marked, in the ranges beside theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()
        for batch in batches:
            rows = []
            for key, page in zip(_keys(batch), batch.column("html").to_pylist()):
                found, order = blocks(page or ""), _order(*key)
                body = [x for x, _ in found], [k for _, k in found]
                rows.append((bisect_right(bounds, order), *key, False, *body))
                if order in edges and order not in sent:
                    sent.add(order)
                    rows += [(k, *key, True, *body) for k in edges[order]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32())]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], _NAMES)

    return pages.mapInArrow(run, _ROW)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Ranges of (host, path, page_id) are dealt out, so a host with a third of all pages takes many
    tasks. The last page of a range is read again before the next range's first, and that one after
    it, so the ranges don't show in the texts. Equal keys are ordered by url and a hash of the html.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in _NAMES]
                yield from (dict(zip(_NAMES, x)) for x in zip(*columns))

        def pairs() -> Iterator[tuple]:
            before, first = None, None
            for row in rows():
                same = before is not None and (before["part"], before["host"]) == (row["part"], row["host"])
                if first is not None:
                    yield first, row if same else None
                    first = None
                if same:
                    yield row, before
                else:
                    first = row
                before = row
            if first is not None:
                yield first, None

        held, size = [], 0
        for row, near in pairs():
            if row["again"]:
                continue
            text = main_text(list(zip(row["lines"], row["kinds"])), near["lines"] if near else None)
            held.append((row["page_id"], row["url"], text, len(text)))
            size += len(text)
            if size > 4 << 20:
                yield _rows(held)
                held, size = [], 0
        if held:
            yield _rows(held)

    width = shuffle_width(small_batches(pages).sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.xxhash64("html").alias("digest"))
    bounds = _bounds(pages, width)
    ordered = _parsed(pages, bounds, _edges(pages, bounds)).repartitionById(width, F.col("part")).sortWithinPartitions("part", *_NAMES[1:6])
    return ordered.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    names, kinds = ["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)
