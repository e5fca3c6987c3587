"""Leaf blocks of an HTML page: a small tolerant parser, linear in the page whatever it holds.

A block is the text between block-level tags, with its character references decoded and its
white space turned into single spaces. Each block knows its ancestor tags and the words of their
class, id and role attributes (those of KNOWN_TAGS and KNOWN_NAMES), how much of it is link text,
and its parent element's number. Comments and the contents of script, style, template, noscript,
head, iframe, object, svg and canvas never give blocks. Only script, style and comments run to
the page's end if they are not closed; a head without its end tag ends at the first tag or text
that can't be in it, any other start tag without its end tag is passed over and what follows is
read. A self-closed svg is empty; formulas are inline text.

A tag ends at the first > outside a quoted attribute value. Once that finds no end, quotes count
for nothing in the rest of the page, so no stretch is read more than twice. References to numbers
of more than seven digits are U+FFFD.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed values of the HTML standard: elements without content, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder"
    " mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics annotation annotation-xml".split()
)
CLOSES_ITSELF = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",),
}
UNSEEN = frozenset("template noscript iframe object svg canvas".split())
#: Tags and attribute words that blocks know of; another attribute word is OTHER.
KNOWN_TAGS = (
    "a article aside b blockquote body button dd div dl dt em fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " i label legend li main menu nav ol p pre section select small span strong table tbody td textarea th tr ul"
).split()
KNOWN_NAMES = (
    "ad ads advert advertisement alert article author banner body bottom breadcrumb byline caption comment comments consent content"
    " cookie copyright discussion entry footer form gdpr header legal list login logo main menu meta modal nav navigation newsletter"
    " notice page pagination popup post promo related replies reply search share sidebar social sponsored sponsor story subscribe tag"
    " tags text toolbar top widget"
).split()
OTHER = ""
#: Tags that say how a text looks, not what holds it.
LOOKS = frozenset("b i em strong span small".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_PART = re.compile(r"[a-z]++")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,}+);?")
_TAG_SET, _NAME_SET = frozenset(KNOWN_TAGS), frozenset(KNOWN_NAMES)
#: Elements that a head may hold.
_IN_HEAD = frozenset("title noscript template meta link base basefont bgsound script style".split())
START, END, NOTHING = range(3)


@dataclass(slots=True)
class Block:
    text: str
    tags: frozenset[str]
    inner: str
    names: frozenset[str]
    depth: int
    parent: int
    link_chars: int


class Reader:
    """Tags, comments and raw elements one after the other, from the place ``at``."""

    def __init__(self, page: str, at: int = 0):
        self.page, self.at, self.quotes, self.last = page, at, True, page.rfind(">")

    def next(self) -> tuple[int, int, str, str] | None:
        """(kind, start, name, attributes) of the next one, or None; ``at`` moves behind it."""
        page, at = self.page, self.at
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                self.at = len(page) if end < 0 else end + 3
                return NOTHING, at, "", ""
            if at > self.last:
                at += 1
                continue
            m = _TAG.match(page, at)
            if m is None:
                if page.startswith(("<!", "<?"), at):
                    self.at = page.index(">", at) + 1
                    return NOTHING, at, "", ""
                at += 1
                continue
            rest = _REST.match(page, m.end()) if self.quotes else None
            self.quotes = rest is not None
            stop = rest.end() if rest else page.index(">", at) + 1
            name = m[2].lower()
            if name in _RAW_ENDS and not m[1]:
                close = _RAW_ENDS[name].search(page, stop)
                self.at = close.end() if close else len(page)
                return NOTHING, at, name, ""
            self.at = stop
            return END if m[1] else START, at, name, page[m.end() : stop - 1]
        self.at = len(page)
        return None


def _unescaped(text: str) -> str:
    """The text with character references decoded."""
    if "&" not in text:
        return text

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0") or "0"
        return f"&#{digits};" if len(digits) < 8 else "�"

    return html.unescape(_LONG_NUMBER.sub(short, text) if "&#" in text else text)


def _name_words(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return frozenset(w if w in _NAME_SET else OTHER for w in _PART.findall(found.lower())) if found else frozenset()


def _self_closed(name: str, attributes: str) -> bool:
    return name == "svg" and attributes.rstrip().endswith("/")


def _closed(page: str) -> dict[int, int]:
    """Start of each unseen element that is closed -> its end. Elements of a name nest."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    reader = Reader(page)
    while found := reader.next():
        kind, start, name, attributes = found
        if name not in UNSEEN:
            continue
        begun = opened.setdefault(name, [])
        if kind == START:
            if not _self_closed(name, attributes):
                begun.append(start)
        elif begun:
            out[begun.pop()] = reader.at
    return out


def _after_head(page: str, at: int, closed: dict[int, int]) -> tuple[int, bool]:
    """Where a head whose start tag ends at ``at`` is over, and whether by its end tag."""
    reader, end, in_title = Reader(page, at), at, False
    here = True  # nothing yet that can't be in a head
    while True:
        before = reader.at
        found = reader.next()
        if here and not in_title and page[before : found[1] if found else len(page)].strip():
            here = False
        if not found:
            return end, False
        kind, start, name, _ = found
        if name == "head" and kind == END:
            return reader.at, True
        if name == "body" and kind == START:
            return (start if here else end), False
        if here:
            if kind == START and name in UNSEEN:
                reader.at = max(reader.at, closed.get(start, reader.at))
            in_title = name == "title" and kind == START
            here = kind == NOTHING or name in _IN_HEAD
            if here:
                end = reader.at


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in order."""
    out: list[Block] = []
    page = page or ""
    # the open elements: name, known tags so far, innermost that is more than looks, known names, number, number of the nearest block-level one
    tags: list[str] = []
    known: list[frozenset[str]] = [frozenset()]
    inner: list[str] = ["body"]
    names: list[frozenset[str]] = [frozenset()]
    ids: list[int] = [0]
    places: dict[str, list[int]] = {}  # of each name among the open elements
    element = 0
    buffer: list[str] = []
    links: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(_unescaped("".join(buffer)).split())
            if text:
                linked = len(" ".join(_unescaped("".join(links)).split())) if links else 0
                out.append(Block(text, known[-1], inner[-1], names[-1], len(tags), ids[-1], linked))
            buffer.clear()
            links.clear()

    def pop_to(depth: int) -> None:
        while len(tags) > depth:
            places[tags.pop()].pop()
            known.pop(), inner.pop(), names.pop(), ids.pop()

    def add(piece: str) -> None:
        if piece:
            buffer.append(piece)
            if places.get("a"):
                links.append(piece)

    reader, closed = Reader(page), None
    whole_heads = True
    while True:
        before = reader.at
        found = reader.next()
        if not found:
            add(page[before:])
            break
        kind, start, tag, attributes = found
        add(page[before:start])
        if kind == NOTHING:
            continue
        if kind == START and (tag in UNSEEN or tag == "head"):
            if closed is None:
                closed = _closed(page)
            if tag in UNSEEN:
                reader.at = max(reader.at, closed.get(start, reader.at))
            elif whole_heads:  # after a head without end tag, further start tags are passed over
                reader.at, whole_heads = _after_head(page, reader.at, closed)
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            add(" ")
            continue
        if kind == END:
            if places.get(tag):
                pop_to(places[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and places.get("p"):
            pop_to(places["p"][-1])
        if tag in CLOSES_ITSELF and places.get(tag):
            last = places[tag][-1]
            if not any(places.get(t) and places[t][-1] > last for t in CLOSES_ITSELF[tag]):
                pop_to(last)
        element += 1
        if not attributes.rstrip().endswith("/") or tag in ("p", "div", "li", "a"):
            places.setdefault(tag, []).append(len(tags))
            tags.append(tag)
            known.append(known[-1] | {tag} if tag in _TAG_SET and tag not in known[-1] else known[-1])
            inner.append(inner[-1] if tag in LOOKS else tag)
            words = _name_words(attributes)
            names.append(names[-1] if words <= names[-1] else names[-1] | words)
            ids.append(ids[-1] if tag in INLINE else element)
    flush()
    return out
