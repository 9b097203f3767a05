"""Main text of web pages: gradient-boosted trees over DOM units, decoded along the tree.

A page's units are its block elements, elements with naming attributes, and runs of loose text
between blocks.  Trees estimate for each unit whether any of the main text lies within it, from the
density of text, links and elements in its subtree, its attribute tokens, its depth, its siblings
and its tag.  A unit can only be part of the main text if all units around it are; decoding picks
the most probable choice that keeps to this, so a menu inside an article goes alone and nothing
inside a footer comes back.

The trees are trained here on pages that a seeded generator builds from the usual ways to mark up
articles and what surrounds them, with the labels known by construction and with the same kind of
sentences on both sides, so that structure and not wording decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from tidepanel.llm import boosting
from tidepanel.llm.common import given_id, identified
from tidepanel.llm.dom import BLOCKS, RAW, Node, parse

PAGES_AT_ONCE = 64

# Tags with a feature of their own.
TAGS = (
    "#text article main section div span p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td blockquote pre figure"
    " figcaption dl dd fieldset details menu dialog address a button label"
).split()
_FLAGS = "nav header footer aside form article main li td button".split()
_TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
_FLAG_INDEX = {t: i for i, t in enumerate(_FLAGS)}
_NAMING = ("class", "id", "role", "itemprop", "aria-label", "data-component", "name")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = re.compile(r"[.,;:!?]")
_NUMBERS, _TOKEN_NUMBERS = 19, 6


class Unit:
    __slots__ = ("tag", "tokens", "parent", "kids", "texts", "size", "linked", "elements", "stops", "words", "count", "depth", "flags", "place", "kept")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: "Unit | None"):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.kids: list[Unit] = []
        self.texts: list[tuple[int, str]] = []  # (place in page order, block) of a unit without units inside
        self.size = self.linked = self.elements = self.stops = self.words = self.place = 0
        self.count = 1
        self.depth = 0 if parent is None else parent.depth + 1
        self.flags = 0 if parent is None else parent.flags
        self.kept = False
        if tag in _FLAG_INDEX:
            self.flags |= 1 << _FLAG_INDEX[tag]


def tokens(attrs: dict[str, str]) -> tuple[str, ...]:
    out = []
    for name in _NAMING:
        if name in attrs:
            out += [t.lower() for t in _TOKEN.findall(attrs[name])]
    return tuple(dict.fromkeys(out))


class Kept(str):
    """Text that a generated page marks as main text."""


def _is_unit(node: Node) -> bool:
    return node.tag in BLOCKS or (bool(node.attrs) and node.tag not in RAW and any(n in node.attrs for n in ("class", "id", "role")) and node.tag != "a")


def units(root: Node) -> list[Unit]:
    """All units with text in them, parents before children; loose runs are units named ``#text``."""
    top = Unit("#page", (), None)
    out = [top]
    run: list[str] = []
    state = {"linked": 0, "elements": 0, "kept": False, "order": 0}

    def flush(owner: Unit) -> None:
        line = " ".join("".join(run).split())
        if line:
            leaf = Unit("#text", (), owner)
            leaf.size, leaf.linked, leaf.elements = len(line), min(state["linked"], len(line)), state["elements"]
            leaf.stops, leaf.words, leaf.kept = len(_STOPS.findall(line)), line.count(" ") + 1, state["kept"]
            leaf.texts.append((state["order"], line))
            state["order"] += 1
            owner.kids.append(leaf)
        run.clear()
        state["linked"] = state["elements"] = 0
        state["kept"] = False

    # An explicit stack: pages may nest deeper than Python calls can.
    stack = [(root, top, iter(root.parts), False)]
    links = 0
    while stack:
        node, owner, parts, opened = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if opened:
                flush(owner)
            if node.tag == "a":
                links -= 1
            continue
        if isinstance(part, str):
            run.append(part)
            if links:
                state["linked"] += len(part.strip())
            state["kept"] = state["kept"] or isinstance(part, Kept)
            continue
        if part.tag in RAW:
            continue
        if part.tag in ("br", "wbr", "img"):
            run.append("" if part.tag == "wbr" else " ")
            continue
        state["elements"] += 1
        links += part.tag == "a"
        if _is_unit(part):
            flush(owner)
            unit = Unit(part.tag, tokens(part.attrs), owner)
            owner.kids.append(unit)
            stack.append((part, unit, iter(part.parts), True))
        else:
            stack.append((part, owner, iter(part.parts), False))
    flush(top)

    order = [top]
    for unit in order:
        order += unit.kids
    for unit in reversed(order):
        if len(unit.kids) == 1 and unit.kids[0].tag == "#text" and unit is not top:
            leaf = unit.kids.pop()  # a block that holds one run is a unit without units inside
            unit.size, unit.linked, unit.elements, unit.stops, unit.words = leaf.size, leaf.linked, leaf.elements, leaf.stops, leaf.words
            unit.texts, unit.kept = leaf.texts, leaf.kept
        else:
            unit.kids = [k for k in unit.kids if k.size]
            for k in unit.kids:
                unit.size += k.size
                unit.linked += k.linked
                unit.elements += k.elements + 1
                unit.stops += k.stops
                unit.words += k.words
                unit.count += k.count
                unit.kept = unit.kept or k.kept
    out, at = [top], 0
    while at < len(out):
        for place, kid in enumerate(out[at].kids):
            kid.place = place
            out.append(kid)
        at += 1
    return out


def table_of(found: list[Unit], odds: dict[str, float]) -> np.ndarray:
    """A row of features per unit; ``odds`` holds for attribute tokens how much they speak for main text."""
    width = _NUMBERS + _TOKEN_NUMBERS + len(TAGS) + len(_FLAGS)
    x = np.zeros((len(found), width), np.float32)
    page = found[0].size + 1
    numbers = []
    lowest: dict[int, float] = {}  # over a unit and all around it
    for row, u in enumerate(found):
        parent = u.parent or u
        kids = parent.kids
        before = kids[u.place - 1] if u.place > 0 and u.parent else None
        after = kids[u.place + 1] if u.parent and u.place + 1 < len(kids) else None
        same = sum(k.tag == u.tag for k in kids[max(0, u.place - 8) : u.place + 9])
        numbers.append(
            (u.depth, u.count, u.size, u.linked / (u.size + 1), u.size / (u.elements + 1), u.words / (u.count), u.stops / (u.words + 1),
             u.size / (u.words + 1), u.size / page, u.size / (parent.size + 1), u.place, len(kids), same, len(kids) - u.place - 1,
             before.size if before else -1, after.size if after else -1, before.linked / (before.size + 1) if before else -1,
             len(u.kids), parent.linked / (parent.size + 1))
        )
        known = [odds[t] for t in u.tokens if t in odds]
        above = lowest[id(u.parent)] if u.parent else 0.0
        lowest[id(u)] = min([above, *known])
        x[row, _NUMBERS : _NUMBERS + _TOKEN_NUMBERS] = (
            min(known, default=0), max(known, default=0), sum(known), len(known), len(u.tokens) - len(known), above
        )
        if u.tag in _TAG_INDEX:
            x[row, _NUMBERS + _TOKEN_NUMBERS + _TAG_INDEX[u.tag]] = 1
        flags, at = parent.flags if u.parent else 0, _NUMBERS + _TOKEN_NUMBERS + len(TAGS)
        while flags:
            low = flags & -flags
            x[row, at + low.bit_length() - 1] = 1
            flags ^= low
    x[:, :_NUMBERS] = numbers
    return x


def decode(found: list[Unit], inside: np.ndarray) -> np.ndarray:
    """Which units are part of the main text, given each one's probability; parents before children.

    Maximises the product of the probabilities of all choices where no unit is in whose parent is out.
    """
    number = {id(u): i for i, u in enumerate(found)}
    p = np.clip(inside, 1e-6, 1 - 1e-6)
    out, best_in = np.log1p(-p), np.log(p)
    all_out, best = out.copy(), np.zeros(len(found))
    for i in range(len(found) - 1, -1, -1):
        for k in found[i].kids:
            j = number[id(k)]
            all_out[i] += all_out[j]
            best_in[i] += best[j]
        best[i] = max(all_out[i], best_in[i])
    chosen = np.zeros(len(found), bool)
    for i, u in enumerate(found):
        free = u.parent is None or (chosen[number[id(u.parent)]] and best_in[i] >= all_out[i])
        chosen[i] = free or (u.tag in ("html", "body") and chosen[number[id(u.parent)]])
    return chosen


class Extractor:
    def __init__(self, trees: boosting.Trees, odds: dict[str, float]):
        self.trees, self.odds = trees, odds

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [units(parse(page or "")) for page in pages]
        tables = [table_of(found, self.odds) for found in parsed]
        inside = self.trees.probability(np.concatenate(tables)) if tables else np.zeros(0)
        out, at = [], 0
        for found in parsed:
            chosen = decode(found, inside[at : at + len(found)])
            at += len(found)
            lines = sorted(line for u, keep in zip(found, chosen) if keep for line in u.texts)
            out.append("\n".join(line for _, line in lines))
        return out


# --- Training pages -------------------------------------------------------------------------

# Names that pages give to their parts, as plain values.
AROUND = {
    "menu": "nav menu navbar navigation topnav mainnav subnav menubar links breadcrumb breadcrumbs toolbar pagination pager skip tabs",
    "header": "header masthead topbar branding logo site top banner tagline title hero",
    "footer": "footer bottom copyright legal colophon site imprint foot credits",
    "sidebar": "sidebar aside widget rail related recommended popular trending more tags secondary column teaser promo side right left",
    "notice": "notice cookie consent gdpr banner alert popup modal overlay paywall disclaimer toast message info privacy warning",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense adslot adbox banner dfp commercial",
    "form": "form newsletter subscribe signup search login register contact poll feedback",
    "comments": "comment comments reader discussion disqus thread respond replies reply responses commentlist feedback forum guestbook",
    "social": "share social sharing follow likes buttons bar tools rating",
}
MAIN = "content article main post entry story body text articlebody maincontent page copy news blog single hentry".split()
_AROUND_TAGS = {
    "menu": ["nav", "nav", "div", "ul", "menu"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
    "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "p", "aside", "dialog"], "advert": ["div", "div", "aside", "section", "p", "span"],
    "form": ["form"], "comments": ["section", "div", "div", "ol", "ul", "aside"], "social": ["div", "ul", "p"],
}


class _Maker:
    def __init__(self, seed: int):
        self.random = np.random.default_rng(seed)

    def pick(self, values):
        return values[int(self.random.integers(len(values)))]

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def some(self, low: int, high: int) -> int:
        return int(self.random.integers(low, high + 1))

    def words(self, n: int) -> str:
        length = self.random.integers(2, 11, n)
        line = " ".join("x" * int(k) for k in length)
        return line + (self.pick([".", ".", ".", "!", "?", "", ","]) if n > 2 or self.chance(0.6) else "")

    def size(self) -> int:
        return int(np.exp(self.random.uniform(0, 5.2)))

    def node(self, tag: str, parent: Node | None, **attrs: str) -> Node:
        made = Node(tag, {k.rstrip("_"): v for k, v in attrs.items() if v}, parent)
        if parent is not None:
            parent.parts.append(made)
        return made

    def named(self, names: list[str], always: bool) -> dict[str, str]:
        if not always and self.chance(0.35):
            return {}
        name = self.pick(names)
        if self.chance(0.3):
            name += self.pick(["-", "_", " "]) + self.pick([self.pick(names), "box", "wrap", "area", "block", "container", "inner", "list", "item", "1"])
        elif self.chance(0.15):
            name = self.pick(["site", "page", "js", "c", "block", "global"]) + "-" + name
        return {self.pick(["class_", "class_", "class_", "id"]): name}

    def inline(self, parent: Node, keep: bool, n: int, link: float = 0.1) -> None:
        kind = Kept if keep else str
        while n > 0:
            k = min(n, self.some(1, 40))
            n -= k
            if self.chance(link):
                self.node("a", parent, href="/x").parts.append(kind(self.words(k)))
            elif self.chance(0.1):
                self.node(self.pick(["b", "i", "em", "strong", "span", "code"]), parent).parts.append(kind(self.words(k)))
            else:
                parent.parts.append(kind(self.words(k)))
            parent.parts.append(kind(" "))
            if self.chance(0.03):
                self.node("br", parent)

    def around(self, kind: str, parent: Node) -> None:
        tag = self.pick(_AROUND_TAGS[kind])
        own = tag in ("nav", "header", "footer", "aside", "form", "menu")
        box = self.node(tag, parent, **self.named(AROUND[kind].split(), always=not own))
        if self.chance(0.25):
            box = self.node("div", box, **self.named(["inner", "wrap", "container", "row", *AROUND[kind].split()], False))
        if tag in ("p", "span") or (kind in ("advert", "notice", "footer", "header") and self.chance(0.45)):
            return self.inline(box, False, min(60, self.size()), link=self.pick([0.0, 0.1, 0.5]))
        if kind in ("menu", "social") or (kind in ("footer", "sidebar") and self.chance(0.5)):
            items = box if box.tag in ("ul", "ol", "menu") else self.node(self.pick(["ul", "ol", "div", "ul"]), box)
            for _ in range(self.some(1, 10)):
                item = self.node("li", items) if items.tag in ("ul", "ol", "menu") else items
                link = self.node("a", item, href="/x") if self.chance(0.9) else item
                link.parts.append(self.words(self.some(1, 4)))
                item.parts.append(" ")
            return None
        if kind == "form":
            for _ in range(self.some(1, 4)):
                field = self.node(self.pick(["p", "div", "label", "fieldset", "span"]), box)
                field.parts.append(self.words(self.some(1, 12)))
                self.node("input", field)
            self.node("button", box).parts.append(self.words(self.some(1, 2)))
            return None
        if self.chance(0.6):
            self.node(self.pick(["h2", "h3", "h4", "p"]), box).parts.append(self.words(self.some(1, 6)))
        for _ in range(self.some(1, 6 if kind == "comments" else 3)):
            entry = box
            if kind == "comments" or self.chance(0.3):
                entry = self.node("li" if box.tag in ("ul", "ol") else self.pick(["div", "article", "div", "div", "div", "section"]), box, **self.named(AROUND[kind].split(), kind == "comments"))
            if kind == "comments" and self.chance(0.4):
                self.node(self.pick(["span", "b", "cite", "div"]), entry, class_=self.pick(["author", "user", "date", "meta"])).parts.append(self.words(2))
            self.inline(self.node(self.pick(["p", "p", "div"]), entry), False, self.size(), link=0.05)
        return None

    def blocks(self, box: Node, n: int) -> None:
        for _ in range(n):
            kind = self.random.random()
            if kind < 0.7:
                self.inline(self.node("p", box, **({"class_": self.pick(["lead", "intro", "text", "p", "first"])} if self.chance(0.06) else {})), True, self.size(), link=self.pick([0, 0, 0.1]))
            elif kind < 0.78:
                self.node(self.pick(["h2", "h3", "h4"]), box).parts.append(Kept(self.words(self.some(1, 9))))
            elif kind < 0.84:
                items = self.node(self.pick(["ul", "ol"]), box)
                for _ in range(self.some(1, 7)):
                    self.inline(self.node("li", items), True, self.some(1, 25), link=0.1)
            elif kind < 0.88:
                quote = self.node("blockquote", box)
                self.inline(self.node("p", quote) if self.chance(0.5) else quote, True, self.some(3, 60))
            elif kind < 0.91:
                rows = self.node("tbody", self.node("table", box))
                for _ in range(self.some(1, 5)):
                    row = self.node("tr", rows)
                    for _ in range(self.some(1, 4)):
                        self.node(self.pick(["td", "td", "th"]), row).parts.append(Kept(self.words(self.some(1, 6))))
            elif kind < 0.94:
                self.node("figcaption", self.node("figure", box)).parts.append(Kept(self.words(self.some(2, 20))))
            elif kind < 0.96:
                self.inline(self.node("pre", box), True, self.some(1, 40))
            else:
                self.inline(self.node("div", box), True, self.size())
            if self.chance(0.12):
                self.around(self.pick(["advert", "advert", "notice", "social", "sidebar", "menu", "form", "comments"]), box)

    def main(self, parent: Node) -> None:
        tag = self.pick(["article", "article", "article", "main", "div", "div", "section", "td", ""])
        box = parent
        if tag:
            if self.chance(0.3):
                box = self.node(self.pick(["main", "div"]), box, **self.named([*MAIN, "wrapper", "container", "row"], False))
            box = self.node(tag, box, **self.named(MAIN, always=tag in ("div", "section", "td") and self.chance(0.8)))
        if self.chance(0.75):
            holder = self.node("header", box) if tag == "article" and self.chance(0.15) else box
            title = self.words(self.some(1, 20))
            self.node("h1" if self.chance(0.9) else "h2", holder).parts.append(Kept(title))
            if self.chance(0.3):  # short pages, and pages that repeat their title
                for _ in range(self.some(1, 2)):
                    self.node("p", box).parts.append(Kept(title if self.chance(0.5) else self.words(self.some(1, 20))))
                if self.chance(0.6):
                    return
        inner = self.node("div", box, **self.named(MAIN, True)) if self.chance(0.2) else box
        self.blocks(inner, self.pick([1, 1, 1, 2, 2, 3, 5, 8, 14, 25]))
        for kind in ("social", "comments", "sidebar", "footer", "form"):
            if tag and self.chance(0.06):
                self.around(kind, box)

    def page(self) -> Node:
        root = Node("#page", {}, None)
        body = self.node("body", self.node("html", root))
        holder = body
        if self.chance(0.3):
            holder = self.node("div", body, **self.named(["page", "wrapper", "container", "site", "root", "app"], False))
        for kind, p in (("notice", 0.3), ("header", 0.45), ("menu", 0.75), ("advert", 0.5), ("form", 0.15), ("sidebar", 0.15)):
            if self.chance(p):
                self.around(kind, holder)
        self.main(self.node("div", holder, **self.named(["row", "layout", "columns", "wrap"], True)) if self.chance(0.15) else holder)
        after = [("advert", 0.25), ("social", 0.2), ("comments", 0.4), ("sidebar", 0.35), ("form", 0.25), ("menu", 0.15), ("notice", 0.2), ("footer", 0.75)]
        for kind, p in after:
            if self.chance(p):
                self.around(kind, holder)
        return root


def train(pages: int = 900, seed: int = 5) -> Extractor:
    """Trees from ``pages`` generated pages; the same for the same seed."""
    maker = _Maker(seed)
    made = [units(maker.page()) for _ in range(pages)]
    halves = [token_odds(made[k::2]) for k in (0, 1)]
    # A page's own labels must not speak through its tokens: each half uses the other half's odds.
    x = np.concatenate([table_of(found, halves[1 - k % 2]) for k, found in enumerate(made)])
    y = np.array([u.kept for found in made for u in found], float)
    return Extractor(boosting.fit(x, y, 1 + y), token_odds(made))  # losing main text weighs twice


def token_odds(pages: list[list[Unit]], least: int = 3) -> dict[str, float]:
    """Smoothed log odds that a unit with an attribute token holds main text, for tokens seen often enough."""
    counts: dict[str, list[int]] = {}
    for found in pages:
        for u in found:
            for t in u.tokens:
                counts.setdefault(t, [0, 0])[u.kept] += 1
    return {t: float(np.log((kept + 1) / (out + 1))) for t, (out, kept) in sorted(counts.items()) if out + kept >= least}


def extracted(pages: DataFrame, model: Extractor | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The whole page is read.  Blocks stand in page order, one per line; a page without main text,
    an empty or a null page has the empty text.  Repeated rows are read each.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model or train())
    schema = T.StructType.fromDDL("id long, url string, text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                texts = shipped.value.texts(part.column(2).to_pylist())
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    out = identified(pages, "url", "html", id_col="page_id").mapInArrow(run, schema)
    return out.select(given_id().alias("page_id"), "url", "text", "n_chars")
