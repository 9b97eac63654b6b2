"""Price evidence of product pages: one pass of a forgiving HTML parser emits every amount with its surroundings, and the
main price block; what they mean is decided in columns.

Pages that are not well formed are read as browsers read them (``Tree``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain import config
from tallygrain.functions.detect import JSON_LD

AMOUNT = re.compile(r"[£€$]\s?\d[\d,]*\.?\d*|\d[\d,]*\.\d{2}\s?(?:GBP|EUR|USD)")
RATE = re.compile(r"[£€$]?\s?\d[\d,]*\.?\d*\s*(?:GBP|EUR|USD)?\s*/\s*(?:kg|litre|l|100\s*g|g|oz|lb|each|unit)", re.I)
REGULAR = re.compile(r"regular\s+price\s+\D{0,3}\d", re.I)
MEMBER = re.compile(r"(?:clubcard|member|prime|loyalty|会员)\s+price\s+(?:is\s+)?\D{0,3}\d", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

# Names of a buy box.
BUY_BOX = ("pdp-buy-box", "buybox", "buy-box", "product-price", "price-block", "value-bar")

EVIDENCE = "url string, pos int, value string, currency string, raw_text string, label string, source string, source_path string, struck boolean, unit_price boolean, member_tier boolean, anchored boolean, css_hint string"
PROMOTION = "url string, kind string, current_price string, reference_price string, member_price string, regular_price string, gated_by string"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)

    def marks(self) -> str:
        return " ".join(v for k, v in self.attrs.items() if v and (k in ("class", "id") or k.startswith("data-"))).lower()

    def tokens(self) -> list[str]:
        """Class names, the id and the three test marks, lower case."""
        own = self.attrs.get("class", "").split() + [self.attrs.get(a, "") for a in ("id", "data-auto", "data-test", "data-testid")]
        return [t.lower() for t in own if t]

    def plain(self) -> str:
        """All text as it stands, without separators, and without scripts, styles and templates."""
        out, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, Node):
                if at is self or at.tag not in ("script", "style", "template"):
                    stack += reversed(at.children)
            else:
                out.append(at)
        return "".join(out)

    def up(self) -> Iterator[Node]:
        at = self
        while at is not None:
            yield at
            at = at.parent

    def texts(self) -> Iterator[tuple[str, Node]]:
        stack = [self]
        while stack:
            at = stack.pop()
            if isinstance(at, tuple):
                yield at
                continue
            if at.tag in ("script", "style"):
                continue
            stack += [c if isinstance(c, Node) else (c, at) for c in reversed(at.children)]

    def text(self) -> str:
        return " ".join(t for t, _ in self.texts())

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            at = stack.pop()
            yield at
            stack += [c for c in reversed(at.children) if isinstance(c, Node)]


# What browsers' tree construction knows of elements.
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
BLOCKS = {
    *("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form"),
    *("header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"),
}
CELLS = {"td", "th", "caption"}
TABLE_PARTS = {"table", "tbody", "thead", "tfoot", "tr"}
#: What ends a search up the tree for an element to close.
WALLS = {"", "html", "table", "template", "button", "object", "applet", "marquee", *CELLS}
#: For a start tag: the open elements that it closes, and what keeps it from looking further up.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "button": ({"button"}, set()),
    "a": ({"a"}, set()),
    **{t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")},
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    **{t: ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot", "caption", "colgroup")},
}


class Tree(HTMLParser):
    """Pages as browsers read them: end tags that are left out are implied, an end tag closes nothing beyond its scope, formatting
    that is closed across blocks or left open goes on where it would, and what has no place in a table stands before it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})
        #: Formatting that is open, or was cut off by the end of a block; None parts a cell's from what is around its table.
        self.active: list[Node | None] = []
        #: What stands before a table, by id, but was open within it: the place that its end leads back to.
        self.back: dict[int, Node] = {}
        self.feed(html)
        self.close()

    # ---- where things go

    def outer(self, node: Node) -> Node | None:
        """The element that was open when this one began."""
        return self.back.get(id(node), node.parent)

    def up(self) -> Iterator[Node]:
        at = self.at
        while at is not None:
            yield at
            at = self.outer(at)

    def stray(self) -> bool:
        """Whether the place is within a table, but in no cell of it."""
        return self.at.tag in TABLE_PARTS and self.root is not self.at

    def put(self, node: Node | str) -> None:
        """Add at the place, or before the table that has no room for it."""
        parent = self.at
        if self.stray() and not (isinstance(node, str) and not node.strip()):
            table = next(n for n in self.up() if n.tag == "table" or n.parent is None)
            if table.parent is not None:
                parent = table.parent
                at = next(i for i, c in enumerate(parent.children) if c is table)
                if isinstance(node, Node):
                    node.parent = parent
                    self.back[id(node)] = self.at
                parent.children.insert(at, node)
                return
        if isinstance(node, Node):
            node.parent = parent
        parent.children.append(node)

    def open(self, tag: str, attrs: dict[str, str], inside: bool = False) -> Node:
        node = Node(tag, attrs)
        if inside:  # parts of a table have their place there
            node.parent = self.at
            self.at.children.append(node)
        else:
            self.put(node)
        self.at = node
        return node

    def reopen(self) -> None:
        """Formatting that a block's end cut off goes on."""
        last = max((i for i, n in enumerate(self.active) if n is None), default=-1)
        held = {id(n) for n in self.up()}
        for i in range(last + 1, len(self.active)):
            if id(self.active[i]) not in held:
                self.active[i] = self.open(self.active[i].tag, self.active[i].attrs)

    def leave(self, node: Node) -> None:
        """Close an element and all within it."""
        for n in self.up():
            if n.tag in CELLS and None in self.active:
                del self.active[len(self.active) - 1 - self.active[::-1].index(None) :]
            if n is node:
                break
        self.at = self.outer(node)

    def close_open(self, tags: set[str], stops: set[str]) -> None:
        """Close the outermost of these that is open this side of what stops the search."""
        found = None
        for n in self.up():
            if n.tag in tags:
                found = n
            if n.tag in stops or n.tag in WALLS - CELLS or n.tag in CELLS and not stops & TABLE_PARTS:
                break
        if found is not None:
            if found.tag in FORMATTING:
                self.active = [n for n in self.active if n is not found]
            self.leave(found)

    # ---- what the parser tells

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        if tag in ("html", "head", "body") and any(n.tag == tag for n in self.walk_open(tag)):
            return
        if tag == "body":
            self.close_open({"head"}, {"html"})
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        if tag in BLOCKS:
            self.close_open({"p"}, set())
            if tag in HEADINGS and self.at.tag in HEADINGS:
                self.leave(self.at)
        if tag in CELLS or tag in ("tr", "tbody", "thead", "tfoot", "colgroup", "col"):
            if not any(n.tag == "table" for n in self.up()):
                return  # a part of no table is no element
            while self.at.tag not in (*TABLE_PARTS, "colgroup"):
                self.at = self.outer(self.at)
            for need in (["tbody", "tr"] if tag in ("td", "th") else ["tbody"] if tag == "tr" else []):
                if self.at.tag == "table" and need == "tbody" or self.at.tag in ("tbody", "thead", "tfoot") and need == "tr":
                    self.open(need, {}, True)
            node = self.open(tag, own, True)
            if tag == "col":
                self.at = node.parent
            if tag in CELLS:
                self.active.append(None)
            return
        if tag not in BLOCKS and tag not in ("script", "style", "template", "title", "meta", "link", "html", "head", "body"):
            self.reopen()
        stray = self.stray() and tag not in ("script", "style", "template")
        back = self.at
        node = self.open(tag, own, self.stray() and not stray)
        if tag in VOID:
            self.at = back
        elif tag in FORMATTING:
            self.active.append(node)

    def walk_open(self, tag: str) -> Iterator[Node]:
        """The open elements, and below the root those that the page may hold once only."""
        yield from self.up()
        yield from (c for top in (self.root, *[n for n in self.root.children if isinstance(n, Node)]) for c in top.children if isinstance(c, Node) and c.tag == tag)

    def handle_endtag(self, tag):
        if tag in ("body", "html"):
            return  # what follows them still belongs to the body
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag in FORMATTING:
            return self.end_formatting(tag)
        walls = WALLS | ({"ul", "ol", "menu"} if tag == "li" else set())
        walls -= {"table"} if tag in TABLE_PARTS or tag in CELLS else set()
        for node in self.up():
            if node.tag == tag and node.parent is not None:
                return self.leave(node)
            if node.tag in walls and not (tag in TABLE_PARTS and node.tag in CELLS) and not (tag == "table"):
                break
            if tag in (*TABLE_PARTS, *CELLS) and node.tag == "table":
                break
        if tag == "p":  # an end without a start is an empty paragraph
            self.put(Node("p", {}))

    def end_formatting(self, tag: str) -> None:
        """Close formatting; of a block that began within it only what came before its end is formatted."""
        last = max((i for i, n in enumerate(self.active) if n is None), default=-1)
        node = next((n for n in reversed(self.active[last + 1 :]) if n.tag == tag), None)
        if node is None:
            return
        self.active = [n for n in self.active if n is not node]
        above = []
        for n in self.up():
            if n is node:
                break
            above.append(n)
        else:
            return  # it was cut off already, and does not go on
        block = next((n for n in reversed(above) if n.tag in BLOCKS or n.tag in CELLS), None)
        if block is None:
            self.at = self.outer(node)
            return
        inner = Node(tag, node.attrs, block, block.children)
        for child in inner.children:
            if isinstance(child, Node):
                child.parent = inner
        block.children = [inner]
        block.parent.children = [c for c in block.parent.children if c is not block]
        block.parent = node.parent
        at = next(i for i, c in enumerate(node.parent.children) if c is node)
        node.parent.children.insert(at + 1, block)
        # blocks that are open within the block stay there, below the formatting that its contents had
        self.at = above[0] if above[0] is not block else block

    def handle_data(self, data):
        if data:
            if data.strip() and self.at.tag not in ("script", "style", "title"):
                self.reopen()
            self.put(data)


def number(text: str) -> str:
    bare = re.sub(r"\s*(?:GBP|EUR|USD)\s*$", "", re.sub("[£€$]", "", text).strip(), flags=re.I).replace(",", "").strip()
    try:
        float(bare)
    except ValueError:
        return ""
    return bare


def dec(text: str | None) -> Decimal | None:
    try:
        return Decimal(text) if text else None
    except InvalidOperation:
        return None


def coin(text: str) -> str:
    up = text.upper()
    return next((code for sign, code in (("£", "GBP"), ("€", "EUR"), ("$", "USD")) if sign in text or code in up), "")


def label_of(raw: str) -> str:
    m = AMOUNT.search(raw)
    words = raw[: m.start()].split() if m else []
    label = " ".join(words[-3:]).lower()
    if not label or (len(label) <= 2 and not label.isascii()) or all(ord(c) > 127 or c == " " for c in label):
        return ""
    return label if any(w in label for w in config.LABEL_WORDS) or len(label) <= 40 else ""


def is_struck(node: Node) -> bool:
    return any(n.tag in ("s", "del", "strike") or "line-through" in n.attrs.get("style", "").lower() or any(c in n.attrs.get("class", "").lower() for c in config.STRUCK_CLASSES) for n in node.up())


def is_zero_decoy(node: Node, value: str) -> bool:
    if (dec(value) or 0) > Decimal("0.001"):
        return False
    near = node.text().lower()
    return "guide price" in near or "basket" in near or any(t in n.marks() for n in node.up() for t in config.ZERO_DECOYS)


def headed_texts(root: Node) -> Iterator[tuple[str, Node, Node | None]]:
    """Texts in order, their element, and the last heading that began before them."""
    heading, stack = None, [root]
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            yield at[0], at[1], heading
            continue
        if at.tag in HEADINGS:
            heading = at
        if at.tag not in ("script", "style"):
            stack += [c if isinstance(c, Node) else (c, at) for c in reversed(at.children)]


def alike(a: str, b: str) -> bool:
    """One text in the other, whatever the case and the blanks."""
    a, b = (" ".join(x.lower().split()) for x in (a, b))
    return a in b or b in a


def is_cross_sell(node: Node, heading: Node | None, title: str) -> bool:
    """Two signs at once: something around the node is named like recommendations, and the heading before it is not the title."""
    named = any(w in " ".join((n.attrs.get("class", ""), n.attrs.get("id", ""))).lower() for n in node.up() for w in config.CROSS_SELL_WORDS)
    return named and not (title and heading is not None and alike(heading.plain(), title))


def main_heading(tree: Node, title: str) -> Node | None:
    """The first <h1> that has the title's words; else, on a page without <main>, the first of all."""
    all_h1 = [n for n in tree.walk() if n.tag == "h1"]
    if title:
        found = next((n for n in all_h1 if n.plain().strip() and alike(n.plain(), title)), None)
        if found or any(n.tag == "main" for n in tree.walk()):
            return found
    return all_h1[0] if all_h1 else None


def json_blocks(html: str) -> Iterator:
    for block in JSON_LD.findall(html):
        try:
            yield json.loads(block)
        except ValueError:
            continue


def json_prices(node, path: str, pid: str | None) -> Iterator[dict]:
    """Prices in a JSON-LD tree, shipping left out; a specification's price is told at both of its places."""
    if isinstance(node, list):
        for i, x in enumerate(node):
            yield from json_prices(x, f"{path}[{i}]", pid)
    elif isinstance(node, dict):
        spec, own = node.get("priceSpecification"), node.get("price")
        at = bool(pid) and (pid in str(node.get("url", "")) or pid in str(node.get("sku", "")))
        base = dict(currency=node.get("priceCurrency") or node.get("currency") or "", raw_text=str(node.get("name", "")), anchored=at)
        dot = f"{path}." if path else ""
        if isinstance(spec, dict) and isinstance(spec.get("price"), int | float):
            yield base | dict(value=str(spec["price"]), source_path=f"{dot}priceSpecification.price", member_tier="validForMemberTier" in spec or "validForMemberTier" in node)
        if isinstance(own, int | float | str) and (v := number(str(own))):
            yield base | dict(value=v, source_path=f"{dot}price", member_tier="validForMemberTier" in node)
        for k, x in node.items():
            if k.lower() not in config.SHIPPING_KEYS:
                yield from json_prices(x, f"{dot}{k}", pid)


def page_title(tree: Node, html: str) -> str:
    """og:title, else a declared product's name, else <title>, without the shop's suffix."""
    meta = next((n.attrs.get("content", "") for n in tree.walk() if n.tag == "meta" and n.attrs.get("property") == "og:title"), "")
    if not meta:
        for data in json_blocks(html):
            for x in data if isinstance(data, list) else [data]:
                if isinstance(x, dict) and x.get("@type") == "Product" and x.get("name"):
                    meta = str(x["name"])
    title = meta or next((n.text() for n in tree.walk() if n.tag == "title"), "")
    for mark in (" | ", " - ", " – "):
        title = title.split(mark)[0]
    return title.strip()


def page_evidence(html: str, pid: str | None, tree: Node | None = None) -> list[dict]:
    """Amounts of the page's text, meta descriptions and JSON-LD: anchored to the product where one of four signs says so, those
    of recommendations left out, one for each value, currency and source."""
    tree = tree or Tree(html).root
    title = page_title(tree, html)
    out: list[dict] = []
    seen = set()
    for text, node, heading in headed_texts(tree):
        rates = [m.span() for m in RATE.finditer(text)]
        for m in AMOUNT.finditer(text):
            value = number(m[0])
            if not value or is_zero_decoy(node, value) or (value, coin(m[0])) in seen:
                continue
            seen.add((value, coin(m[0])))
            hints = " ".join(n.marks() for n in node.up() if n.marks())[:200]
            out.append(dict(value=value, currency=coin(m[0]), raw_text=text.strip()[:200], label=label_of(text), source="dom_text", source_path="", struck=is_struck(node), unit_price=any(a <= m.start() < b for a, b in rates), css_hint=hints, node=node, heading=heading))
    for n in tree.walk():
        name = (n.attrs.get("name") or n.attrs.get("property") or "").lower()
        if n.tag == "meta" and name in config.META_NAMES:
            content = n.attrs.get("content", "")
            for m in AMOUNT.finditer(content):
                if value := number(m[0]):
                    around = content[max(0, m.start() - 60) : m.end() + 40]
                    label = "regular" if REGULAR.search(around) else "member" if MEMBER.search(around) else ""
                    out.append(dict(value=value, currency=coin(m[0]), raw_text=content[:200], label=label, source="meta", source_path=f"meta:{name}"))
    for data in json_blocks(html):
        out += [dict(source="json_ld", **p) for p in json_prices(data, "", pid)]
    trusted = {dec(e["value"]) for e in out if e.get("anchored")} - {None}
    block, head = price_block(tree, trusted), main_heading(tree, title)
    kept, seen = [], set()
    for e in out:
        node, heading = e.pop("node", None), e.pop("heading", None)
        if node is not None and is_cross_sell(node, heading, title):
            continue
        if (e["value"], e["currency"], e["source"]) in seen:
            continue
        seen.add((e["value"], e["currency"], e["source"]))
        around = [*node.up()] if node is not None else []
        e["anchored"] = bool(
            e.get("anchored")  # the product's own JSON-LD says so
            or dec(e["value"]) in trusted  # or has the same value
            or (block is not None and any(n is block for n in around))  # or it stands in the main price block
            or (head is not None and any(n is head for n in around))  # or in the main heading
            or (pid and around and (pid in e["raw_text"] or any(pid in n.plain()[:500] for n in around)))  # or beside the product's id
        )
        kept.append(e)
    return kept


def gating(block: Node) -> str | None:
    """The membership scheme that gates a block's price: by class (unless negated), phrase, or badge."""
    for n in block.walk():
        for cls in n.marks().split() if n is block else ():
            for hint in config.MEMBER_HINTS:
                if hint in cls:
                    return None if re.search(rf"\b(?:non|not|no)[-_]?{re.escape(hint)}\b", cls) else hint
    low = block.text().lower()
    for phrase in config.GATING_PHRASES:
        if phrase in low:
            return phrase
    for n in block.walk():
        badge = n.tag in ("svg", "img") or any(b in m for m in (n.marks(), n.parent.marks() if n.parent else "") for b in config.BADGE_HINTS)
        if badge:
            for hint in config.MEMBER_HINTS:
                if hint in n.text().lower() or hint in n.marks():
                    return hint
    return None


def block_prices(block: Node) -> list[dict]:
    out: dict[str, dict] = {}
    for text, node in block.texts():
        for m in AMOUNT.finditer(text):
            if (v := number(m[0])) and not RATE.match(text[m.start() :]):
                out.setdefault(v, dict(value=v, label=label_of(text), struck=is_struck(node), marks=" ".join(n.marks() for n in node.up())))
    return list(out.values())


def price_block(tree: Node, trusted: set[Decimal]) -> Node | None:
    """The block that most looks like the main price, among those in <main> (else <body>) that are named like one and have eight
    characters: +100 with a trusted value, +50 for each of its names that is a buy box's, +30 of middle size, +25 with any price,
    +40 with a trusted value and a higher one that is struck or labelled as a reference, +10 with words of a membership scheme,
    +35 inside the main heading's parent. Of equals the middle-sized, then the first; if none scores, likewise."""
    nodes = [*tree.walk()]
    scope = next((n for t in ("main", "body") for n in nodes if n.tag == t), tree)
    h1 = next((n for n in nodes if n.tag == "h1"), None)
    found: list[tuple[int, bool, Node]] = []
    for n in scope.walk():
        names = n.tokens()
        if n is scope or n.tag in ("script", "style", "noscript") or not any(h in t for t in names for h in config.CONTAINER_HINTS):
            continue
        text = n.plain()
        size = len(text.strip())
        if size < 8:
            continue
        prices = [(dec(p["value"]), p) for p in block_prices(n)]
        values = {v for v, _ in prices}
        middle = 20 <= size <= 2000
        score = 100 * bool(values & trusted) + 50 * sum(any(h in t for h in BUY_BOX) for t in names) + 30 * middle + 25 * bool(prices)
        score += 40 * any(v is not None and v > t and is_reference(p) for t in trusted & values for v, p in prices)
        score += 10 * any(h in text.lower() for h in config.MEMBER_HINTS)
        score += 35 * (h1 is not None and h1.parent is not None and any(a is h1.parent for a in n.up() if a is not n))
        found.append((score, middle, n))
    return max(found, key=lambda x: (x[0], x[1]), default=(0, False, None))[2]


def is_reference(price: dict) -> bool:
    return price["struck"] or any(w in price["label"] for w in config.REFERENCE_HINTS)


def promotion(html: str, pid: str | None, membership_possible: bool = True) -> dict | None:
    """membership, discount or neither, with the prices that tell; null without a price block."""
    tree = Tree(html).root
    evidence = page_evidence(html, pid, tree)
    trusted = {dec(e["value"]) for e in evidence if e["anchored"]} - {None}
    block = price_block(tree, trusted)
    if block is None:
        return None
    prices = sorted(((dec(p["value"]), p) for p in block_prices(block) if dec(p["value"]) is not None), key=lambda x: x[0])
    if not prices:
        return None
    program = gating(block) if membership_possible else None
    own = [x for x in prices if x[0] in trusted]
    fair = [x for x in own if not is_reference(x[1])]
    anchored = bool(own)
    value, now = (fair[-1] if program else fair[0]) if fair else own[0] if own else prices[0]
    higher = [x for x in prices if x[0] > value]
    out = dict(kind=None, current_price=now["value"], reference_price=None, member_price=None, regular_price=None, gated_by=program)
    if program:
        if anchored:
            lower = [p for v, p in prices if v < value and any(h in p["marks"] or h in p["label"] for h in [*config.MEMBER_HINTS, program])]
            return out | dict(kind="membership", member_price=lower[-1]["value"] if lower else None, regular_price=now["value"])
        return out | dict(kind="membership", member_price=now["value"], regular_price=higher[-1][1]["value"] if higher else None)
    refs = [p for _, p in higher if is_reference(p)]
    if refs:
        return out | dict(kind="discount", reference_price=refs[-1]["value"])
    return out


def price_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html", pid_col: str | None = None) -> DataFrame:
    """One row for each amount of each page, in order of appearance."""
    pid = F.col(pid_col) if pid_col else F.lit(None).cast("string")
    schema = pa.schema([("url", pa.string()), ("pos", pa.int32()), *[(n, pa.string()) for n in ("value", "currency", "raw_text", "label", "source", "source_path")], *[(n, pa.bool_()) for n in ("struck", "unit_price", "member_tier", "anchored")], ("css_hint", pa.string())])
    usual = dict(label="", source_path="", struck=False, unit_price=False, member_tier=False, anchored=False, css_hint="")

    def run(batches):
        for batch in batches:
            rows = [usual | e | dict(url=u, pos=i) for u, h, p in zip(*(c.to_pylist() for c in batch.columns)) for i, e in enumerate(page_evidence(h or "", p))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), pid.alias("pid")).mapInArrow(run, EVIDENCE)


def promotions(pages: DataFrame, url_col: str = "url", html_col: str = "html", pid_col: str | None = None) -> DataFrame:
    """One row for each page that has a price block."""
    pid = F.col(pid_col) if pid_col else F.lit(None).cast("string")
    schema = pa.schema([(n, pa.string()) for n in ("url", "kind", "current_price", "reference_price", "member_price", "regular_price", "gated_by")])

    def run(batches):
        for batch in batches:
            rows = [dict(url=u, **p) for u, h, i in zip(*(c.to_pylist() for c in batch.columns)) if (p := promotion(h or "", i))]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"), pid.alias("pid")).mapInArrow(run, PROMOTION)


def plain_context(html: Column, head: int = 3000, body: int = 5000) -> Column:
    """Without a parser: the JSON-LD blocks and fixed slices of the page."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    return F.struct(blocks.alias("json_ld"), F.substring(html, 1, head).alias("head"), F.substring(html, head + 1, body).alias("body"))


def distrusted(price: Column, list_price: Column, member: Column, raw_availability: Column, kind: Column) -> Column:
    """Why a parser's fast result is not to be trusted: an availability blob, or a promotion it missed."""
    return (
        F.when(raw_availability.contains("{") | raw_availability.contains("@context") | (F.length(raw_availability) > 80), "availability_blob")
        .when((kind == "membership") & member.isNull(), "missed_membership")
        .when((kind == "discount") & list_price.isNull(), "missed_discount")
    )


def page_titles(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url and canonical title of every page."""

    def run(batches):
        for batch in batches:
            htmls = [h or "" for h in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([page_title(Tree(h).root, h) for h in htmls], pa.string())], ["url", "title"])

    return pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "url string, title string")
