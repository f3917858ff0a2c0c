"""Main text of web pages: nearest-URL page differencing on text lines.

Every page is paired with the page of its host whose URL path is nearest: of its two neighbours in path order the one with the longer common
path prefix. The text lines of both are aligned by longest common subsequence; shared lines are the site's template and are deleted.

Lines come from the markup: a block element ends a line. Lines that the markup itself names as no main text (menus, headers, footers,
sidebars, notices, adverts, forms, comments; scripts and styles have no lines) go in any case, and so do inline elements with such a name: by element, by
role, or by the first or last part of a class or id, unless another part makes it a state of the page. Inside an element that the markup names as
the main text (``article``, ``main``) shared lines stay, since there they are the article's own: copies, quotes and first sentences that articles
share would be lost otherwise. Without such an element, all lines outside of it that are not shared make the text.

Defined cases: null and empty pages have an empty text; urls without ``://`` have host and path empty and are paired with each other; a
page alone on its host is not differenced; of equally near neighbours the one before is taken; repeated rows stand next to each other and
share all their lines outside of named main text; unclosed elements end with their parent; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.llm.common import utf8
from stopfield.llm.order import in_order
from stopfield.llm.url_filter import host_and_path

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN = frozenset(("article", "main"))
UNNAMED = frozenset(("html", "body", "main"))
OTHER = frozenset("nav header footer aside form button dialog menu".split())
OTHER_ROLES = frozenset("alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OTHER_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adslot banner banners breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies disclaimer disqus footer masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notices notification popup promo "
    "promotion related reply replies respond share sharing sidebar sidebars skyscraper social sponsor sponsored subscribe subscription toolbar "
    "widget widgets".split()
)
STATES = frozenset("has no not non with without is are open opened closed enabled disabled allowed active inactive layout template type count".split())
"""Parts of a name that make it say something about the element (``has-sidebar``, ``comments-open``) and not what it is."""


def _names_other(token: str) -> bool:
    """Whether a name's first or last part is in the list, and no part makes it a state: ``site-footer``, ``ad-slot`` and ``cookie-bar`` are other."""
    parts = [part.lower() for part in _NAME_PART.findall(token)]
    return bool(parts) and (parts[0] in OTHER_NAMES or parts[-1] in OTHER_NAMES) and STATES.isdisjoint(parts)


def _is_other(name: str, rest: str, in_main: bool, by_name: bool) -> bool:
    if name in OTHER and not (name == "header" and in_main):
        return True
    if not rest.strip(" /"):
        return False
    for attribute, *values in _ATTRIBUTE.findall(rest):
        attribute, value = attribute.lower(), "".join(values)
        if attribute == "hidden" or attribute == "aria-hidden" and value.strip().lower() == "true" or attribute == "style" and _NOT_SHOWN.search(value):
            return True
        if by_name and (
            attribute in ("class", "id") and any(map(_names_other, value.split()))
            or attribute == "role" and not OTHER_ROLES.isdisjoint(value.lower().split())
            or attribute == "aria-label" and _names_other(value)
        ):
            return True
    return False


def text_lines(page: str) -> list[tuple[str, bool, bool]]:
    """The lines of a page in order: the text, whether it stands in named main text, whether in something named as none.

    The names of ``html``, ``body``, ``main`` and of what a ``main`` stands in do not count; those of an ``article``, and of what it stands in, do
    not count if no named main text were left (of several articles the one that is called a comment goes).
    """
    lines, around = _lines(page, frozenset())
    if around["main"]:
        lines, _ = _lines(page, frozenset(around["main"]))
    if (around["main"] or around["article"]) and not any(main and not other for _, main, other in lines):
        lines, _ = _lines(page, frozenset(around["main"] | around["article"]))
    return lines


def _lines(page: str, free: frozenset[int]) -> tuple[list[tuple[str, bool, bool]], dict[str, set[int]]]:
    """The lines, where the names of elements that start at ``free`` do not count; and the starts of elements around main elements whose names count."""
    around: dict[str, set[int]] = {name: set() for name in MAIN}
    starts: list[int | None] = []
    lines: list[tuple[str, bool, bool]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    muted: list[str] = []  # inline elements named as no main text, from the outermost on
    main = other = False

    def end_line() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            lines.append((text, main, other))

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at and not muted:
            buffer.append(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if muted:
                if token["close"] and name in muted:
                    while muted.pop() != name:
                        pass
                elif not token["close"] and name not in VOID:
                    muted.append(name)
            elif not token["close"] and name not in VOID and token["rest"].strip(" /") and _is_other(name, token["rest"], main, True):
                muted.append(name)
            continue
        muted.clear()  # a block ends what an inline element has not
        end_line()
        if name in VOID or token["rest"].endswith("/") and name not in MAIN:
            continue
        if not token["close"]:
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                starts.pop()
            by_name = name not in UNNAMED and token.start() not in free
            if name in MAIN:
                around[name].update(x for x in starts if x is not None)
                if name == "article" and by_name and not other and _is_other(name, token["rest"], main, True):
                    around[name].add(token.start())
            other_now = other or _is_other(name, token["rest"], main, by_name)
            starts.append(token.start() if by_name and other_now and not _is_other(name, token["rest"], main, False) else None)
            stack.append((name, main, other))
            main, other = main or (name in MAIN and not other_now), other_now
        else:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                _, main, other = stack[depth]
                del stack[depth:], starts[depth:]
    if at < len(page) and not muted:
        rest = page[at:]
        buffer.append(rest if re.match(r"</?[a-zA-Z]", rest) is None else "")
    end_line()
    return lines, around


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit rows of the longest common subsequence table of ``a`` with each prefix of ``b``: bit i is 0 where a[i] lengthens it."""
    full = (1 << len(a)) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full
    yield row
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


MOST_BITS = 1 << 26


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``. Long pairs are halved first, so memory stays bounded."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner_a, inner_b = range(head, len(a) - tail), b[head : len(b) - tail]
    both = set(inner_b) & {a[i] for i in inner_a}
    kept = [i for i in inner_a if a[i] in both]
    x, y = [a[i] for i in kept], [v for v in inner_b if v in both]
    out: list[int] = []
    if x and y and len(x) * len(y) > MOST_BITS and len(y) > 1:
        half = len(y) // 2
        lengths = []
        for u, v in ((x, y[:half]), (x[::-1], y[half:][::-1])):
            *_, row = _rows(u, v)
            bits = np.frombuffer(row.to_bytes((len(u) + 7) // 8, "little"), np.uint8)
            lengths.append(np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(u)])]))
        cut = int(np.argmax(lengths[0] + lengths[1][::-1]))
        out = [kept[i] for i in common(x[:cut], y[:half])] + [kept[cut + i] for i in common(x[cut:], y[half:])]
    elif x and y:
        rows = list(_rows(x, y))
        i, j = len(x), len(y)
        while i and j:
            if rows[j] >> (i - 1) & 1:
                i -= 1
            elif not rows[j - 1] >> (i - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append(kept[i])
        out.reverse()
    return [*range(head), *out, *range(len(a) - tail, len(a))]


def main_text(lines: list[tuple[str, bool, bool]], nearest: list[tuple[str, bool, bool]] | None) -> str:
    """The text of the lines that are main text, those shared with the nearest page deleted outside of named main text."""
    shared: set[int] = set()
    if nearest is not None:
        shared = set(common([hash(x[0]) for x in lines], [hash(x[0]) for x in nearest]))
    named = any(main for _, main, other in lines if not other)
    return " ".join(text for i, (text, main, other) in enumerate(lines) if not other and (main or not named and i not in shared))


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in path order: each is paired when the one after it is known. Three pages are held at a time."""
    previous = current = None  # (bucket, copy, page_id, url, host, path, lines)
    rows: list[tuple] = []

    def told(page, before, after) -> tuple:
        near = [p for p in (before, after) if p is not None and p[0] == page[0] and p[4] == page[4]]
        nearest = max(near, key=lambda p: _prefix(p[5], page[5]))[6] if near else None  # the first of equals
        text = main_text(page[6], nearest)
        return page[2], page[3], text, len(text)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_chars"])

    for batch in batches:
        for i in range(batch.num_rows):
            bucket, copy, page_id, url, host, path, page = (batch.column(c)[i].as_py() for c in range(7))
            following = (bucket, copy, page_id, url, host, path, text_lines(page))
            if current is not None and not current[1]:
                rows.append(told(current, previous, following))
            previous, current = current, following
            if len(rows) >= 256:
                yield batch_of(rows)
                rows = []
    if current is not None and not current[1]:
        rows.append(told(current, previous, None))
    if rows:
        yield batch_of(rows)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (integer page_id, url, html): page_id, url, the main ``text`` and its length ``n_chars`` in code points."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", utf8(F.col("html").cast("string")).alias("html"))
    placed = rows.withColumns({"host": host, "path": path, "id_key": F.coalesce("page_id", F.lit(-(2**63)).cast("long")), "digest": F.xxhash64("url", "html")})
    keys = ["host", "path", "id_key", "digest"]
    near = in_order(placed, keys, before=True, after=True)
    lined = near.sortWithinPartitions("bucket", *keys).select("bucket", "copy", "page_id", "url", "host", "path", "html")
    return lined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
