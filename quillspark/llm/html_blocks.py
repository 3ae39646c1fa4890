"""HTML pages as leaf blocks of text with their ancestors."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict

#: A tag. A quote opens a string only after =; no part is read twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+|[\"'])*+)>")
#: The same, ended by the first >: where strings would hide the end of the page.
_SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKUP = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))|=\s*(?:\"[^\"]*\"|'[^']*')", re.I)
_NAME = re.compile(r"[a-z]+")

# Elements of HTML by how they cut text.
RAW = frozenset("script style template".split())
#: Elements inside lines whose text counts and whose tag stands in the path.
EMBEDDED = frozenset("noscript svg iframe object canvas math audio video".split())
PLAIN = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
_HOLDS = frozenset("ul ol dl table select body html article section div nav aside main footer header form td th blockquote".split())
#: How many of the nearest ancestors a block's path has.
DEPTH = 64


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role."""
    out: list[str] = []
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        if key:
            out += _NAME.findall((a or b or c).lower())
    return tuple(dict.fromkeys(out))


class _Open:
    """The open elements, with where each tag stands, so that no step looks through all of them."""

    def __init__(self):
        self.items: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.holders: list[int] = []
        self.shown: list[int] = []  # those that a path shows

    def push(self, tag: str, names: tuple[str, ...] = ()) -> None:
        k = len(self.items)
        self.items.append((tag, names))
        self.at[tag].append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in _HOLDS:
            self.holders.append(k)
        if tag in BLOCK or names or tag in EMBEDDED:
            self.shown.append(k)

    def cut(self, k: int) -> None:
        """Close the elements from the k-th on."""
        while len(self.items) > k:
            self.at[self.items.pop()[0]].pop()
        for places in (self.blocks, self.holders, self.shown):
            while places and places[-1] >= k:
                places.pop()

    def close(self, tag: str) -> None:
        """Close tag and what stands in it; one inside lines only up to the next block."""
        if self.at[tag] and (tag in BLOCK or not self.blocks or self.at[tag][-1] > self.blocks[-1]):
            self.cut(self.at[tag][-1])

    def make_room(self, tag: str) -> None:
        """Close what a new block ends: an open paragraph, the item before."""
        closes = _CLOSES.get(tag, frozenset())
        above = next((k for k in reversed(self.holders) if self.items[k][0] not in closes), -1)
        ends = [places[k] for t in ("p", *closes) if (places := self.at[t]) and (k := bisect_left(places, above)) < len(places)]
        if ends:
            self.cut(min(ends))

    def path(self, around) -> tuple:
        """Nearest DEPTH elements that a path shows; `around` before the last."""
        out = [self.items[k] for k in self.shown[-DEPTH:]]
        out[-1:-1] = [(tag, ()) for tag in around if all(tag != x[0] for x in out)]
        return tuple(out)

    def embedded(self) -> list[str]:
        return [t for t in EMBEDDED if self.at.get(t)]


class _Reader:
    """Markup of a page from front to back."""

    def __init__(self, page: str):
        self.page, self.last, self.tag = page, page.rfind(">"), _TAG

    def next(self, at: int):
        """(start, end, match of a tag or None) of the next markup from `at` on, or None."""
        page = self.page
        if found := _MARKUP.search(page, at):
            lt = found.start()
            if lt > self.last:  # no tag ends from here on: text, up to a comment
                lt = page.find("<!--", lt)
                return None if lt < 0 else (lt, len(page), None)
            if found.group() in ("<!", "<?"):
                comment = page.startswith("<!--", lt)
                end = page.find("-->", lt + 2) if comment else page.find(">", lt)
                return lt, len(page) if end < 0 else end + (3 if comment else 1), None
            m = self.tag.match(page, lt)
            if not m:
                self.tag = _SHORT
                m = _SHORT.match(page, lt)
            return lt, m.end(), m
        return None


def leaf_blocks(page: str | None) -> list[tuple[str, tuple, int, bool]]:
    """(text, path, linked, first) of each block in page order.

    A block is a run of text that no block element cuts, its white space turned
    into single spaces. path has a (tag, names) for each open element; linked is
    how many of its characters stand in links. Scripts, styles, comments and
    templates are left out and cut no block; character references are decoded. Of
    these only a script may stay open to the page's end; where another is not
    closed, what follows is read as usual. An embedded element (math, object, ...)
    counts as an ancestor of each block that has text of it.

    Each character is read a bounded number of times. Where strings would hide the
    end of the page, tags end at their first >. A comment that does not end hides what
    follows; any other markup that does not end is text.
    """
    blocks: list[tuple[str, tuple, int]] = []
    open_ = _Open()
    text: list[str] = []
    around: dict[str, None] = {}  # embedded elements that the block's text stands in
    linked = links = at = 0
    if not page:
        return []

    def end_block() -> None:
        nonlocal linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                blocks.append((said, open_.path(around), min(linked, len(said))))
            text.clear()
        around.clear()
        linked = 0

    n, reader = len(page), _Reader(page)
    open_to_end: set[str] = set()  # elements that no tag closes from here on
    embedded = False
    while at < n:
        found = reader.next(at)
        stop = found[0] if found else n
        if stop > at:
            piece = page[at:stop]
            text.append(piece)
            if embedded and not piece.isspace():
                around.update((t, None) for t in open_.embedded())
            if links:
                linked += len(piece)
        if not found:
            break
        _, at, m = found
        if m is None:
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag in RAW or tag in PLAIN:
            if closing or attributes.endswith("/"):
                continue
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, at) if tag not in open_to_end else None
            if tag == "textarea":
                end_block()
            if close is None and tag != "script":
                open_to_end.add(tag)
                if tag == "style":  # its rules are no text
                    at = k if (k := page.find("<", at)) >= 0 else n
                continue
            if tag == "textarea":
                open_.push(tag)
                text.append(page[at : close.start()])
                end_block()
                open_.cut(len(open_.items) - 1)
            at = close.end() if close else n
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK:
            end_block()
            if tag == "hr":
                continue
            if closing:
                open_.close(tag)
                links = 0
            else:
                open_.make_room(tag)
                open_.push(tag, _names(attributes) if attributes else ())
        elif tag in VOID:
            continue
        elif closing:
            open_.close(tag)
        elif (names := _names(attributes) if attributes else ()) or (tag in EMBEDDED and not attributes.endswith("/")):
            open_.push(tag, names)
            embedded = embedded or tag in EMBEDDED
    end_block()
    return [(said, path, linked, i == 0) for i, (said, path, linked) in enumerate(blocks)]
