"""HTML pages to ordered blocks with the standard library's parser, and block-level steps."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements that never hold content; class and id pieces of page furniture; content roots by (element, attribute, value); headings.
DROP_TAGS = frozenset("script style noscript template svg canvas iframe form button input select textarea video audio nav aside".split())
CHROME = (
    "dropdownUI loggedOut_ footerTopSection footerSection letterLinks cookieBanner cookieConsent consentBanner gdpr shareWidget socialShare share-buttons shareButton breadcrumb breadCrumb "
    "promoBanner promoModule promotional offerBanner newsletterSignup newsletter subscribeForm popupModal headerNav siteHeader navbar menuIcon hamburger stickyBar floatingAction backToTop "
    "tooltip ratingStar appBanner installApp searchBox searchInput"
).split()
ROOTS = [("div", "class", "pw14MainWrapper"), ("div", "class", "pw14ContentWrapper"), ("div", "class", "layout-main"), ("div", "class", "layout-container"), ("main", "", ""), ("article", "", ""), ("", "role", "main")]
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
EMITTED = HEADINGS | {"p", "li", "tr"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP_TEXT = re.compile(r"^\s*(?:log ?in|sign ?in|sign ?up|register)\b|\bdownload the app\b|^\s*share\b|^\s*reviews?\b", re.I)
MIN_ROOT, MAX_TERM_WORDS, ROW_CHARS = 200, 12, (3, 260)
WHITE = re.compile("[ \t \n\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                stack += reversed(x.children)
        return WHITE.sub(" ", " ".join(parts)).strip()

    def longer_than(self, limit: int) -> bool:
        """Whether its text is; no more of it is read than that takes."""
        parts, size, stack = [], 0, [self]
        while stack:
            x = stack.pop()
            if not isinstance(x, str):
                stack += reversed(x.children)
                continue
            parts.append(x)
            size += len(x)
            if size > limit:
                parts = [WHITE.sub(" ", " ".join(parts)).strip()]
                size = len(parts[0])
                if size > limit:
                    return True
        return len(WHITE.sub(" ", " ".join(parts)).strip()) > limit


class _Builder(HTMLParser):
    """A lenient tree: an end tag closes the nearest open element of its name; unclosed paragraphs end at the next block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.at.tag == "p" and tag in EMITTED | {"div", "ul", "ol", "table", "section", "article"}:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        if data.strip():
            self.at.children.append(data)


def _is_root(node: Node, tag: str, attribute: str, value: str) -> bool:
    return (not tag or node.tag == tag) and (not attribute or value in node.attrs.get(attribute, "").split())


def _strip(root: Node) -> None:
    for node in list(root.walk()):
        kept = []
        for child in node.children:
            if isinstance(child, Node):
                marks = child.attrs.get("class", "") + " " + child.attrs.get("id", "")
                if child.tag in DROP_TAGS or any(p in marks for p in CHROME):
                    continue
                if not any(isinstance(c, Node) for c in child.children) and DROP_TEXT.search(child.text()):
                    continue
            kept.append(child)
        node.children = kept


class Seen:
    """Texts, and whether another one stands within one of them.

    The first ``PLAIN`` questions search all texts; should there be more, places of all stretches of ``SPAN`` characters are noted, and a
    text is looked for where its rarest stretch stands.  Texts shorter than that are among all pieces of their length or not.  So work
    grows with the size of the texts, and not with their number times that."""

    SPAN, PLAIN = 12, 256

    def __init__(self, texts: list[str]):
        self.texts, self.whole, self.joined, self.asked = list(texts), set(texts), "\n".join(texts), 0
        self.places: dict[str, list[tuple[int, int]]] | None = None
        self.pieces: dict[int, set[str]] = {}

    def _note(self, number: int) -> None:
        text = self.texts[number]
        for i in range(len(text) - self.SPAN + 1):
            self.places.setdefault(text[i : i + self.SPAN], []).append((number, i))

    def add(self, text: str) -> None:
        self.whole.add(text)
        self.texts.append(text)
        if self.places is None:
            self.joined += "\n" + text
            return
        self._note(len(self.texts) - 1)
        for size, known in self.pieces.items():
            known.update(text[i : i + size] for i in range(len(text) - size + 1))

    def holds(self, text: str) -> bool:
        if text in self.whole:
            return True
        self.asked += 1
        if self.asked <= self.PLAIN:
            return text in self.joined
        if self.places is None:
            self.places = {}
            for n in range(len(self.texts)):
                self._note(n)
        size = len(text)
        if size >= self.SPAN:
            found, at = min(((self.places.get(text[i : i + self.SPAN], ()), i) for i in range(size - self.SPAN + 1)), key=lambda p: len(p[0]))
            return any(i >= at and self.texts[n].startswith(text, i - at) for n, i in found)
        if size not in self.pieces:
            self.pieces[size] = {t[i : i + size] for t in self.texts for i in range(len(t) - size + 1)}
        return text in self.pieces[size]


def _outermost(root: Node):
    """Emitted elements that stand in no other, and the root itself if it is one."""
    stack = [(root, root.parent is not None and root.parent.tag in EMITTED)]
    while stack:
        node, inside = stack.pop()
        if node.tag in EMITTED and (not inside or node is root):
            yield node
        inside = inside or node.tag in EMITTED
        stack += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]


def _leaf_pieces(node: Node) -> list[str]:
    return [t for c in node.children if isinstance(c, Node) and not any(isinstance(g, Node) for g in c.children) and (t := c.text())]


def parse_blocks(html: str) -> list[tuple[str, str, str | None]]:
    """(kind, text, section) of a page in order: headings, paragraphs, items and table rows;
    then label and value rows of generic containers; then leaf texts not yet seen.  Of equal
    texts the first stays."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    nodes = list(builder.root.walk())
    root = next((n for r in ROOTS for n in nodes if _is_root(n, *r) and n.longer_than(MIN_ROOT)), None) or next((n for n in nodes if n.tag == "body"), builder.root)
    _strip(root)
    blocks: list[tuple[str, str, str | None]] = []
    section = None
    for node in _outermost(root):
        text = node.text()
        if not text:
            continue
        if node.tag in HEADINGS:
            section = text
            blocks.append(("heading", text, section))
        elif node.tag == "tr":
            cells = [t for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and (t := c.text())]
            caption = _caption(node, section)
            row = f"{caption} | {cells[0]}" if len(cells) == 1 else " | ".join(cells)
            if cells:
                blocks.append(("table_row", f"{caption} | {row}", section))
        else:
            blocks.append(("list_item" if node.tag == "li" else "paragraph", text, section))
    for node in root.walk():
        if node.tag in ("div", "section") and not any(c.tag in HEADINGS for c in node.children if isinstance(c, Node)):
            pieces = _leaf_pieces(node)
            row = " | ".join(pieces)
            if len(pieces) >= 2 and ROW_CHARS[0] <= len(row) <= ROW_CHARS[1] and all(len(p.split()) <= MAX_TERM_WORDS for p in pieces):
                if not any(c.tag in EMITTED for c in node.children if isinstance(c, Node)):
                    blocks.append(("fact_row", row, section))
    seen = Seen([b[1] for b in blocks])
    for node in root.walk():
        if not any(isinstance(c, Node) for c in node.children) and (text := node.text()) and not seen.holds(text):
            blocks.append(("text", text, section))
            seen.add(text)
    first: dict[str, tuple[str, str, str | None]] = {}
    for b in blocks:
        first.setdefault(b[1], b)
    return list(first.values())


def _caption(row: Node, section: str | None) -> str:
    table = row
    while table is not None and table.tag != "table":
        table = table.parent
    if table is None:
        return section or "Table"
    own = next((c.text() for c in table.children if isinstance(c, Node) and c.tag == "caption"), "")
    return own or table.attrs.get("aria-label", "") or section or "Table"


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, ordinal, kind, text, section)."""

    def run(batches):
        for batch in batches:
            rows = [(k, i, *b) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, b in enumerate(parse_blocks(h or ""))]
            columns = list(zip(*rows)) or [[]] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "ordinal", "kind", "text", "section"])

    return pages.select(key, html).mapInArrow(run, f"page_id {pages.schema[key].dataType.simpleString()}, ordinal int, kind string, text string, section string")


def strip_markup(html: Column) -> Column:
    """Text of a page by pattern alone, for comparison and for pages without structure."""
    names = "script|style|noscript|template|svg|canvas|iframe|form|button|nav|aside"
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, rf"(?is)<(?:{names})\b[^>]*>.*?</(?:{names})>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def flat_text(blocks: DataFrame) -> DataFrame:
    """(page_id, flat_text): blocks joined by line ends, runs of blank lines cut to one."""
    rows = blocks.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("b"))
    joined = F.regexp_replace(F.array_join("b.text", "\n"), r"\n{3,}", "\n\n")
    return rows.select("page_id", F.trim(joined, F.lit(" \t\n\r")).alias("flat_text"))


def dedup_blocks(blocks: DataFrame) -> DataFrame:
    """First of equal texts in a page; ordinals anew from 0."""
    place = F.row_number().over(Window.partitionBy("page_id", "text").orderBy("ordinal"))
    again = F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal")) - 1
    return blocks.withColumn("place", place).where("place = 1").drop("place").withColumn("ordinal", again)


def thin(pages: DataFrame, minimum: int, text: str = "flat_text") -> DataFrame:
    """Pages under the minimum: these are failures, not pages."""
    return pages.where(F.length(text) < minimum)
