"""Main text of web pages: nearest-URL page differencing, with the page's own markup for what differencing cannot tell.

1. Each page is cut into blocks of text, the lines to compare: tags end blocks, character references are decoded, white
   space becomes one space. Scripts, styles, comments of the markup and the head give no lines.
2. Pages are ordered by host, path, query and id (a range shuffle, so a host with a third of all pages is many tasks). Copies and
   near copies of a page (0.9 of the characters of both in equal lines, menus and the like not counted) tell nothing of its
   template. Its partner is the nearest URL before or after it on the same host that is none: of these two the one that
   shares the longer beginning of the path, the earlier one among equals. Where a run of copies goes on in other ranges, it
   is found among the outermost pages of each range and the next ones unlike them, which all tasks know. A page whose host
   has only copies of it keeps its lines.
3. The lines of page and partner are aligned by their longest common subsequence (bit-parallel, exact). Shared lines are the
   template of the site and are deleted,
4. except inside the page's marked article (article, main or their roles): passages there are often repeated on other pages of
   a site, and deleting them would lose text. Lines that the partner does not share stay, inside the article and outside.
5. Lines in menus, headers, footers, sidebars, forms and the like go by their element or role, also where the partner does not
   share them. Of class and id, only an exact name (``ad``, ``comments``; not ``has-sidebar``) does that, and only for a small
   block: no heading, no section of an article, nothing around an article or h1, and at most half of the page's text unless
   an article is marked elsewhere. All other names delete only lines that the partner shares, also inside an article. An article
   element that is named a comment or a teaser, or is in a block that is, is such a block and marks no article.

Defined results: null html is empty; a page without a text line has the empty text; a null or unreadable URL is host and path "";
unclosed elements end with what contains them, an unclosed comment or script ends the page; repeated rows are pages of their
own. An empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import saved, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
CHROME = frozenset("nav footer header aside form menu dialog button".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = (
    r"ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|notification|alert|sidebar|side-bar|menu|nav|navbar"
    r"|navigation|breadcrumbs?|footer|header|masthead|comments?|discussion|disqus|share|sharing|social|related|recommended|popup|modal|newsletter|subscribe|login|search|pager|pagination|toolbar"
)
CHROME_NAME = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:$|[\s_-])", re.I)
EXACT_NAME = re.compile(rf"(?:^|\s)(?:{_NAMES})(?:$|\s)", re.I)
#: Names with which an article element is no article of the page.
OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|teasers?|related|recommended|promo|sponsor(?:ed)?)(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
URL = re.compile(r"[a-zA-Z][\w+.-]*://([^/?#]*)([^?#]*)(.*)", re.S)

ARTICLE, BOILERPLATE, NAMED = 1, 2, 4

#: Share of the characters in equal lines from which on pages count as near copies.
ALIKE = 0.9


def lines(page: str) -> tuple[list[str], bytes]:
    """(lines, kind of each): kind has the bits ARTICLE, BOILERPLATE and NAMED (boilerplate if the partner shares it)."""
    out: list[str] = []
    kinds = bytearray()
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, and the bits that hold inside them
    blocks: list[list] = []  # [depth, first line, line behind it, whether it may go, whether of comments or teasers], exact names
    bits, at = 0, 0

    def closed(depth: int) -> None:
        for block in blocks:
            if block[2] is None and block[0] >= depth:
                block[2] = len(out)

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append(text)
                kinds.append(bits)

    def text_until(end: int) -> None:
        if end > at:
            piece = page[at:end]
            buffer.append(entities.unescape(piece) if "&" in piece else piece)

    position = 0
    while match := TAG.search(page, position):
        text_until(match.start())
        at = position = match.end()
        name = match[2]
        if name is None:  # comment, declaration
            continue
        name = name.lower()
        if match[1]:
            inside = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name not in INLINE:
                flush()
            if inside is not None:
                if any(tag not in INLINE for tag, _ in stack[inside:]):
                    flush()
                closed(inside)
                del stack[inside:]
                bits = stack[-1][1] if stack else 0
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in RAW and not match[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, position)
            at = position = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name == "p" and any(tag == "p" for tag, _ in stack):  # a paragraph ends the one before
            inside = max(k for k, (tag, _) in enumerate(stack) if tag == "p")
            if all(tag in INLINE or tag == "p" for tag, _ in stack[inside:]):
                closed(inside)
                del stack[inside:]
                bits = stack[-1][1] if stack else 0
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(match[3])} if match[3] else {}
        role = found.get("role", "").lower()
        names = f"{found.get('class', '')} {found.get('id', '')}"
        marked = name in ("article", "main") or role in ("main", "article")
        within = any(block[2] is None and block[4] for block in blocks)
        other = marked and name != "main" and role != "main" and (within or OTHER_ARTICLE.search(names))
        if name == "h1" or marked and not other:
            for block in blocks:
                block[3] = block[3] and block[2] is not None  # open blocks are wrappers
        if marked and not other:
            bits |= ARTICLE
        elif name in CHROME or role in CHROME_ROLES:
            bits |= BOILERPLATE
        elif name not in ("html", "body") and name not in INLINE and name not in HEADINGS and (other or CHROME_NAME.search(names)):
            bits |= NAMED
            if other or EXACT_NAME.search(names) and not (name == "section" and bits & ARTICLE):
                blocks.append([len(stack), len(out), None, True, bool(other or OTHER_ARTICLE.search(names))])
        stack.append((name, bits))
    text_until(len(page))
    flush()
    closed(0)
    if small := [block for block in blocks if block[3]]:
        sizes = np.array([0 if kind & BOILERPLATE else len(line) for line, kind in zip(out, kinds, strict=True)], np.int64)
        in_article = np.frombuffer(bytes(kinds), np.uint8) & (ARTICLE | BOILERPLATE) == ARTICLE
        for _, start, stop, *_ in small:
            elsewhere = in_article[:start].any() or in_article[stop:].any()
            if elsewhere or 2 * sizes[start:stop].sum() <= sizes.sum():
                for k in range(start, stop):
                    kinds[k] |= BOILERPLATE
    return out, bytes(kinds)


def location(url: str | None) -> tuple[str, str, str]:
    match = URL.match(url or "")
    return (match[1].lower(), match[2].rstrip("/") or "/", match[3]) if match else ("", "", "")


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places in ``own`` of a longest common subsequence with ``other``."""
    masks: dict[int, int] = {}
    for k, line in enumerate(other.tolist()):
        masks[line] = masks.get(line, 0) | 1 << k
    full = (1 << len(other)) - 1
    rows, row = [], full
    for line in own.tolist():
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, i, j = [], len(own), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return np.array(found[::-1], np.int64)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _alike(a: dict, b: dict) -> bool:
    """Whether two pages are copies or near copies: equal lines hold nearly all characters of both."""
    if a["hashes"] == b["hashes"]:
        return True
    most = max(sum(a["sizes"]), sum(b["sizes"]))
    left = Counter(b["hashes"])
    same = 0
    for line, size in zip(a["hashes"], a["sizes"], strict=True):
        if size and left[line] > 0:
            left[line] -= 1
            same += size
    return same >= ALIKE * most


def _partner(page: dict, before: dict | None, after: dict | None) -> dict | None:
    near = [x for x in (before, after) if x is not None]
    return max(near, key=lambda x: _common(x["path"] + x["query"], page["path"] + page["query"]), default=None)


def _main_text(page: dict, partner: dict | None) -> str:
    text = zlib.decompress(page["body"]).decode("utf-8", "surrogatepass")
    kinds = np.frombuffer(page["kinds"], np.uint8)
    if not len(kinds):
        return ""
    shared = np.zeros(len(kinds), bool)
    if partner is not None:
        shared[shared_lines(np.asarray(page["hashes"]), np.asarray(partner["hashes"]))] = True
    article = (kinds & (ARTICLE | NAMED)) == ARTICLE
    keep = ((kinds & BOILERPLATE) == 0) & (article | ~shared)
    return "\n\n".join(line for line, kept in zip(text.split("\n"), keep, strict=True) if kept)


PARSED = "page_id bigint, url string, host string, path string, query string, kinds binary, body binary"
_LINES = [("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("query", pa.string()), ("kinds", pa.binary()), ("body", pa.binary())])
_NEAR = pa.schema([("host", pa.string()), ("path", pa.string()), ("query", pa.string()), *_LINES])
_TIP = pa.schema([("range", pa.int32()), ("place", pa.int32()), *_NEAR])
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, kinds = lines(page or "")
            host, path, query = location(url)
            body = zlib.compress("\n".join(found).encode("utf-8", "surrogatepass"), 6)
            rows.append({"page_id": page_id, "url": url, "host": host, "path": path, "query": query, "kinds": kinds, "body": body})
        yield pa.RecordBatch.from_pylist(rows, _PARSED)


def _with_lines(page: dict) -> dict:
    """The page and what stands for its lines: hashes, and characters outside menus and the like. Neither is shuffled."""
    found = zlib.decompress(page["body"]).split(b"\n") if page["kinds"] else []
    hashes = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in found]
    sizes = [0 if kind & BOILERPLATE else len(x.decode("utf-8", "surrogatepass")) for x, kind in zip(found, page["kinds"], strict=True)]
    return {**page, "hashes": hashes, "sizes": sizes}


def _near(page: dict) -> dict:
    return {k: page[k] for k in _NEAR.names}


def tips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's first page and the next one unlike it on its host, the last one unlike its last page, and that one."""
    first = second = last = unlike = None
    for batch in batches:
        for row in batch.to_pylist():
            page = _near(_with_lines(row))
            if first is None:
                first = page
            elif second is None and page["host"] == first["host"] and not _alike(first, page):
                second = page
            if last is not None:
                if last["host"] != page["host"]:
                    unlike = None
                elif not _alike(last, page):
                    unlike = last
                elif unlike is not None and _alike(unlike, page):
                    unlike = None
            last = page
    found = [(place, page) for place, page in enumerate((first, second, unlike, last)) if page is not None]
    if found:
        yield pa.RecordBatch.from_pylist([{"range": TaskContext.get().partitionId(), "place": place, **page} for place, page in found], _TIP)


def difference(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of a range of pages in order, from the tips (range, place, page) of all ranges in order."""

    def beyond(page: dict, pages: Iterator[dict]) -> dict | None:
        """The nearest page of other ranges that is no copy."""
        for other in pages:
            if other["host"] != page["host"]:
                return None
            if not _alike(page, other):
                return other
        return None

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        earlier = [x for x in reversed(known.value) if x["range"] < here]
        later = [x for x in known.value if x["range"] > here]
        run: list[list] = []  # [page, partner before it] of the pages that wait for the next one unlike them
        out = []

        def ended(page: dict, before: dict | None, after: dict | None) -> None:
            out.append({"page_id": page["page_id"], "url": page["url"], "text": _main_text(page, _partner(page, before, after))})

        past: list[dict] = []  # pages of this host, latest first: one of each run
        for batch in batches:
            for page in map(_with_lines, batch.to_pylist()):
                if past and past[0]["host"] != page["host"]:
                    for x, before in run:
                        ended(x, before, None)
                    run, past = [], []
                    earlier = []
                waiting = []
                for x, before in run:
                    if _alike(x, page):
                        waiting.append([x, before])
                    else:
                        ended(x, before, page)
                before = next((x for x in past if not _alike(page, x)), None) or beyond(page, iter(earlier))
                if past and past[0]["hashes"] == page["hashes"]:  # copies share one list of lines
                    page["hashes"], page["sizes"] = past[0]["hashes"], past[0]["sizes"]
                run = [*waiting, [page, before]]
                latest = _near(page)
                past = [latest, *(x for x in past if not _alike(latest, x))][:2]
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, _OUT)
                    out.clear()
        for x, before in run:
            ended(x, before, beyond(x, iter(later)))
        if out:
            yield pa.RecordBatch.from_pylist(out, _OUT)

    return texts


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text), one row per row of ``pages``."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    order = ["host", "path", "query", "page_id"]
    placed = saved(rows.mapInArrow(parse, PARSED).repartitionByRange(*order).sortWithinPartitions(*order))
    near = "host string, path string, query string, hashes array<bigint>, sizes array<bigint>"
    ends = placed.mapInArrow(tips, f"range int, place int, {near}").collect()  # at most four rows of a range
    known = spark.sparkContext.broadcast([x.asDict() for x in sorted(ends, key=lambda x: (x.range, x.place))])
    return placed.mapInArrow(difference(known), "page_id bigint, url string, text string")
