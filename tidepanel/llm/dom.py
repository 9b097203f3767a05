"""A forgiving HTML reader: nested elements with their attributes, text and implied ends."""

from __future__ import annotations

import html
import re

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg select xmp noembed noframes title".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
    " caption legend option optgroup head".split()
)
#: What a start tag ends: these open elements, looked for up to the nearest of the borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_SCOPE = frozenset("td th table button body html".split())

_MARK = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: A comment may also be ended by its own opening bracket.
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />]|\Z)", re.ASCII | re.IGNORECASE) for tag in RAW}
#: A bare attribute value at the end of a tag; a slash that ends it belongs to it.
_OPEN_VALUE = re.compile(r"""=\s*[^\s"'][^\s]*\Z""")
_IN_TAG = re.compile(r"""=\s*(["'])|>""")  # a quote opens a value only after an equals sign
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []  # children and runs of decoded text, in page order


def attributes(body: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(body):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The tree of a page.  Comments, declarations and the content of raw elements are left out."""
    root = Node("#page", {}, None)
    here, at, size = root, 0, len(page)
    ends = _TagEnds(page)
    while at < size:
        found = _MARK.search(page, at)
        if found is None:
            here.parts.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            here.parts.append(html.unescape(page[at : found.start()]))
        at = found.start()
        mark = found.group()
        if mark == "<!--":
            end = _COMMENT_END.search(page, at + 4)
            at = size if end is None else end.end()
            continue
        if mark in ("<!", "<?"):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, at + len(mark) - 1)
        tag = name.group().lower()
        end = ends.after(name.end())
        body, at = page[name.end() : end - 1], end
        if mark[1] == "/":
            here = _ended(here, tag)
            continue
        here = _closed(here, tag)
        node = Node(tag, attributes(body) if body.strip() else {}, here)
        here.parts.append(node)
        if tag in RAW:
            if tag == "svg" and body.endswith("/") and not _OPEN_VALUE.search(body):
                continue  # a foreign element may close itself
            stop = _RAW_END[tag].search(page, at)
            at = size if stop is None else stop.start()
        elif tag not in VOID:
            here = node  # a slash before the bracket does not end an HTML element
    return root


class _TagEnds:
    """Finds where tags end, with quoted values of any length, in time linear in the page over all calls."""

    def __init__(self, page: str):
        self.page = page
        self.last = {'"': page.rfind('"'), "'": page.rfind("'")}
        self.lost: set[int] = set()  # opening quotes from which no tag end can be reached

    def after(self, at: int) -> int:
        """The place after a tag's closing bracket, or the end of a page that is cut off within the tag.

        If a quoted value is never closed, the first bracket ends the tag.
        """
        page, here, opened = self.page, at, []
        while (found := _IN_TAG.search(page, here)) is not None:
            quote = found.group(1)
            if quote is None:
                return found.end()
            opened.append(found.end() - 1)
            if opened[-1] in self.lost or self.last[quote] < found.end():
                break
            here = page.index(quote, found.end()) + 1
        self.lost.update(opened)
        close = page.find(">", at)
        return len(page) + 1 if close < 0 else close + 1


def _ended(here: Node, tag: str) -> Node:
    node = here
    while node.parent is not None and node.tag != tag:
        if tag not in BLOCKS and node.tag in _SCOPE:
            return here
        node = node.parent
    if node.parent is None or tag in ("body", "html"):
        return here  # no such element is open; what follows the end of the body still belongs to it
    return node.parent


def _closed(here: Node, tag: str) -> Node:
    if tag in CLOSES:
        ends, borders = CLOSES[tag]
        node = here
        while node.parent is not None and node.tag not in borders:
            if node.tag in ends:
                return node.parent
            node = node.parent
        return here
    if tag in BLOCKS:  # a block ends an open paragraph
        node = here
        while node.parent is not None and node.tag not in _SCOPE and (node.tag not in BLOCKS or node.tag == "p"):
            if node.tag == "p":
                return node.parent
            node = node.parent
    return here
