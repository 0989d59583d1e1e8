"""Main text of HTML pages by a maximum-scoring subsequence of words and tags.

1. A page is read once into tags and text nodes.  Every element hands features down to the text in
   it: its name, words of its class, id and role, and whether it is the page's article or main
   element or stands beside it.  A block of text adds its share of links, size and kind.
2. Two logistic regressions are learned from the labelled pages of ``htmlpages``.  One, which sees
   neither size nor wording, tells furniture.  The other sees all features of pages without an
   article or main element and gives the log odds of a word's standing in main text; elsewhere the
   first one does.  A tag's weight is the log odds of its name there, scaled to serve these pages best.
3. Words score their log odds if positive, those of furniture nothing; tags score negative.  One
   linear scan finds the contiguous run with the best total, and the text in it that isn't
   furniture is the result.  Where no word scores, the whole page is the run.

Names on html, body and on an element that holds the article say nothing, nor do they on a
wrapper: an element with over three quarters of the page's plain words.

Edges: a null or empty page has an empty text; a comment, script or style that isn't closed
runs to the end; a tag that isn't closed is text; character references are decoded once; white
space inside a block, ``<br>`` included, becomes one space, and blocks are joined by one; repeated
rows are treated each by itself; other columns are ignored.  Nothing is cut off, however long a
page is, and the time is linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.htmlpages import labelled_pages
from corpusforge.llm.scratch import lean

#: Element names by role.
SKIPPED = frozenset("script style noscript template textarea title iframe object svg canvas audio video math select".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open one of the named kinds.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
IMPLIED |= dict.fromkeys(("tbody", "thead", "tfoot"), {"tbody", "thead", "tfoot", "tr", "td", "th"})
INLINE = frozenset(("a", "span", "button", "label"))
#: Elements with features of their own.
NAMED_PARTS = {x: x for x in "nav footer aside header form button dialog menu head table figure blockquote label".split()}
NAMED_PARTS |= {"ul": "list", "ol": "list", "dl": "list", "fieldset": "form", "datalist": "form", "details": "details"}
FURNITURE = frozenset("nav footer aside form button dialog menu head".split())
#: Words in class, id and role attributes, by what they name.
HINTS = {
    "ads": "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored",
    "comments": "comment comments commentlist discussion disqus replies reply respond",
    "nav": "breadcrumb breadcrumbs menu menus nav navbar navigation pager pagination skip submenu toolbar",
    "side": "complementary rail sidebar sidebars widget widgets",
    "foot": "colophon contentinfo copyright disclaimer footer imprint legal",
    "top": "header masthead topbar",
    "share": "follow share sharing social",
    "cookie": "consent cookie cookies gdpr",
    "notice": "alert alertdialog dialog modal notice notices overlay popup warning",
    "promo": "newsletter paywall promo promotion signup subscribe subscription",
    "related": "recommendations recommended related teaser teasers",
    "form": "form login search searchbox signin",
}
FAMILY = {word: family for family, words in HINTS.items() for word in words.split()}
#: Words that add nothing to a name beside them.
GENERIC = frozenset("area articles bar block bottom box buttons container left link links main page posts right section site slot top unit us wrap wrapper".split())

#: What tells furniture, and what else tells main text.
STRUCTURE = ["main", "beside", "header in main", "hidden", "links few", "links many", "links only", "linked text"]
STRUCTURE += sorted(set(NAMED_PARTS.values())) + [f"{family} {how}" for family in HINTS for how in ("named", "in part", "small")]
WORDING = ["paragraph", "heading", "item", "cell", "quote", "1-3 words", "4-9 words", "10-24 words", "25 words", "ends a sentence", "legal wording"]
BIT = {name: 1 << i for i, name in enumerate(STRUCTURE + WORDING)}
MARKED = BIT["main"] | BIT["beside"]
_KIND = {"p": BIT["paragraph"], "li": BIT["item"], "dt": BIT["item"], "dd": BIT["item"], "td": BIT["cell"], "th": BIT["cell"], "pre": BIT["quote"], "blockquote": BIT["quote"]}
_KIND |= dict.fromkeys(HEADINGS, BIT["heading"])
_SMALL = HEADINGS | {"p", "span", "a", "li", "td", "th", "pre", "label", "figcaption", "dt", "dd"}

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)>""")
_PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORDS = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
_LEGAL = re.compile(r"©|\(c\)|copyright|rights reserved|\bcookies?\b|privacy policy|newsletter|\bsubscribe\b|advertisement|\bimprint\b", re.I)
#: More than this share of a page's plain words, 3 of 4, makes an element a wrapper.
WRAPPER = 3, 4

TEXT, START, END = 0, 1, 2


def tokens(html: str):
    """(kind, text or tag name, attributes, place) of a page, in order."""
    at, n = 0, len(html)
    unclosed: set[str] = set()  # what is known not to occur any more
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or ">" in unclosed:
            yield TEXT, html[at:], "", at
            return
        following = html[lt + 1 : lt + 2]
        if following in ("!", "?"):
            if lt > at:
                yield TEXT, html[at:lt], "", at
            mark = "-->" if html.startswith("<!--", lt) else ">"
            end = html.find(mark, lt + 2)
            at = end + len(mark) if end >= 0 else n
            continue
        if not (following.isascii() and following.isalpha() or following == "/"):
            yield TEXT, html[at : lt + 1], "", at
            at = lt + 1
            continue
        if html.find(">", lt) < 0:
            unclosed.add(">")
            continue
        tag = _TAG.match(html, lt) or _PLAIN_TAG.match(html, lt)
        if not tag:
            yield TEXT, html[at : lt + 1], "", at
            at = lt + 1
            continue
        if lt > at:
            yield TEXT, html[at:lt], "", at
        name = tag[1].lower()
        at = tag.end()
        yield END if following == "/" else START, name, tag[2], lt
        if name in SKIPPED and following != "/" and not tag[2].endswith("/") and name not in unclosed:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "title", "textarea", "noscript", "template"):
                at = n
            else:
                unclosed.add(name)


def hints(attributes: str, small: bool) -> tuple[set[str], bool]:
    """The hint features of an element's attributes, and whether its role is that of main text."""
    found, role = set(), False
    for attribute, value in _NAMED.findall(attributes):
        for name in value.strip("\"'").lower().split():
            if attribute.lower() == "role" and name in MAIN:
                role = True
            words = _WORDS.findall(name)
            families = {FAMILY[w] for w in words if w in FAMILY}
            whole = all(w in FAMILY or w in GENERIC or w.isdigit() for w in words)
            found |= {f"{family} {'small' if small and whole else 'named' if whole else 'in part'}" for family in families if whole or not small}
    return found, role


class Page:
    """The tags and text nodes of a page in order, with the features of each.

    items: (START or END, tag name, features of the place, place in html) and
    (TEXT, decoded text, features, place, words)."""

    def __init__(self, html: str):
        names, parents, rest, plain = ["#page"], [-1], [""], [0]
        stack, opened = [0], Counter()
        listed: list[tuple] = []  # kind, text or name, innermost element, place, inside a link

        def close():
            opened[names[stack.pop()]] -= 1

        for kind, name, attributes, place in tokens(html):
            if kind == TEXT:
                text = unescape(name)
                words, link = len(text.split()), opened["a"] > 0
                if words and not link and not any(opened[x] for x in FURNITURE):
                    plain[stack[-1]] += words
                listed.append((TEXT, text, stack[-1], place, words, link))
                continue
            if kind == START:
                if name in BLOCKS and opened["p"]:
                    while names[stack[-1]] != "p":
                        close()
                    close()
                elif name == "a" and names[stack[-1]] == "a":
                    close()
                if name in IMPLIED:
                    while names[stack[-1]] in IMPLIED[name] or names[stack[-1]] in INLINE and opened[name]:
                        close()
                listed.append((START, name, stack[-1], place))
                if name in SKIPPED or name in VOID or name not in BLOCKS and name not in INLINE or attributes.endswith("/") and name not in BLOCKS:
                    continue
                names.append(name)
                parents.append(stack[-1])
                rest.append(attributes)
                plain.append(0)
                stack.append(len(names) - 1)
                opened[name] += 1
                continue
            if opened[name] and name in INLINE:
                at = len(stack) - 1
                while names[stack[at]] in INLINE and names[stack[at]] != name:
                    at -= 1
                if names[stack[at]] == name:
                    while len(stack) > at:
                        close()
                else:
                    opened[name] = 0  # a block stands open in it; it ends here for all that
            elif opened[name] > 0:
                while names[stack[-1]] != name:
                    close()
                close()
            listed.append((END, name, stack[-1], place))
        self._features(names, parents, rest, plain)
        self.items = self._blocks(listed, names, parents)

    def _features(self, names: list[str], parents: list[int], rest: list[str], plain: list[int]):
        """self.inside: the features handed down by each element; self.marked: whether the page has an article or main element."""
        count = len(names)
        whole = list(plain)
        for i in range(count - 1, 0, -1):
            whole[parents[i]] += whole[i]
        own = [hints(rest[i], names[i] in _SMALL) if rest[i] else (set(), False) for i in range(count)]
        # The page's article: article elements, or main elements if these hold more than twice as many words.
        lost = [False] * count  # named as furniture, or inside of what is
        regions: dict[str, list[int]] = {"article": [], "main": []}
        within = {"article": [False] * count, "main": [False] * count}
        for i in range(1, count):
            p = parents[i]
            lost[i] = lost[p] or names[i] in FURNITURE or bool(rest[i]) and any(x.endswith(" named") for x in own[i][0]) and not own[i][1] and whole[i] * WRAPPER[1] <= whole[0] * WRAPPER[0]
            for kind in regions:
                within[kind][i] = within[kind][p]
                if (names[i] == kind or kind == "main" and own[i][1]) and not within[kind][p] and (not lost[i] or names[i] in MAIN and not any(x.endswith(" named") for x in own[i][0]) and self._left_open(i, names, parents)):
                    within[kind][i] = True
                    regions[kind].append(i)
        size = {kind: sum(whole[i] for i in found) for kind, found in regions.items()}
        region = "article" if regions["article"] and 2 * size["article"] >= size["main"] else "main"
        chosen = set(regions[region])
        self.marked = bool(chosen)
        holds = [False] * count  # an article or a chosen element inside
        for i in range(count - 1, 0, -1):
            holds[i] |= i in chosen
            holds[parents[i]] |= holds[i]
        inside = [BIT["beside"] if self.marked else 0] + [0] * (count - 1)
        for i in range(1, count):
            name, mask = names[i], inside[parents[i]]
            if i in chosen:
                mask = BIT["main"]
            part = NAMED_PARTS.get(name)
            if part == "header" and mask & BIT["main"]:
                part = "header in main"
            if name in FURNITURE:
                mask &= ~BIT["main"]
            if part:
                mask |= BIT[part]
            if rest[i]:
                if _HIDDEN.search(rest[i]):
                    mask |= BIT["hidden"]
                wrapper = name in ("html", "body") or holds[i] and i not in chosen or whole[i] * WRAPPER[1] > whole[0] * WRAPPER[0]
                for feature in own[i][0]:
                    if not wrapper or feature == "comments named" and not holds[i]:
                        if i not in chosen or feature.endswith(" named"):
                            mask |= BIT[feature]
            inside[i] = mask
        self.inside = inside

    @staticmethod
    def _left_open(i: int, names: list[str], parents: list[int]) -> bool:
        """Whether an article or main element stands in a nav or head that must have been left open."""
        p = parents[i]
        steps = 0
        while p > 0 and steps < 50:
            if names[p] in ("nav", "head", "menu"):
                return True
            if names[p] in ("aside", "footer", "form", "dialog"):
                return False
            p, steps = parents[p], steps + 1
        return False

    def _blocks(self, listed: list[tuple], names: list[str], parents: list[int]) -> list[tuple]:
        out: list[tuple] = []
        block: list[int] = []
        kind_of = [0] * len(names)  # of the nearest block element with a kind
        for i in range(1, len(names)):
            kind_of[i] = _KIND.get(names[i], kind_of[parents[i]] if names[i] not in BLOCKS else 0)

        def close():
            words = sum(out[i][4] for i in block)
            if words:
                linked = sum(out[i][4] for i in block if out[i][5])
                kind = out[block[0]][6]
                text = "".join(out[i][1] for i in block).strip()
                mask = kind | BIT["1-3 words" if words < 4 else "4-9 words" if words < 10 else "10-24 words" if words < 25 else "25 words"]
                if linked:
                    prose = kind & (BIT["paragraph"] | BIT["heading"])
                    mask |= BIT["linked text" if prose else "links few" if linked * 10 <= words * 3 else "links many" if linked * 10 <= words * 6 else "links only"] if not prose or linked * 10 > words * 6 else 0
                if _STOP.search(text[-8:]):
                    mask |= BIT["ends a sentence"]
                if words < 25 and _LEGAL.search(text):
                    mask |= BIT["legal wording"]
                for i in block:
                    out[i] = (TEXT, out[i][1], out[i][2] | mask, *out[i][3:5])
            else:
                for i in block:
                    out[i] = out[i][:5]
            block.clear()

        for item in listed:
            if item[0] == TEXT:
                _, text, element, place, words, link = item
                block.append(len(out))
                out.append((TEXT, text, self.inside[element], place, words, link, kind_of[element]))
            else:
                if item[1] in BLOCKS:
                    close()
                out.append((item[0], item[1], self.inside[item[2]], item[3]))
        close()
        return out


def _tag_key(name: str, mask: int) -> str:
    """In a page with an article or main element, tags count by where they stand."""
    return "in main" if mask & BIT["main"] else "beside main" if mask & BIT["beside"] else name


def regression(masks: list[int], labels: list[int], bits: list[str], ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights of the bits, and the intercept at the end, by Newton's method."""
    x = np.array([[bool(m & BIT[b]) for b in bits] + [True] for m in masks], float)
    y, w = np.array(labels, float), np.zeros(len(bits) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.append(np.full(len(bits), ridge), 1e-6)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Weights:
    """What is learned from labelled pages."""

    def __init__(self, pages: list[list[tuple[int, str]]]):
        masks, labels, inside, outside = [], [], Counter(), Counter()
        read = []
        for pieces in pages:
            bounds = np.cumsum([0, *(len(m) for _, m in pieces)]).tolist()
            page = Page("".join(m for _, m in pieces))
            wanted = []
            for item in page.items:
                label = pieces[bisect_right(bounds, item[3]) - 1][0]
                if item[0] == TEXT:
                    if item[4]:
                        masks.append(item[2])
                        labels.append(label)
                        wanted.append((item, label))
                else:
                    (inside if label else outside)[_tag_key(item[1], item[2])] += 1
            read.append((page, wanted))
        self.structure = regression(masks, labels, STRUCTURE)
        unmarked = [i for i, m in enumerate(masks) if not m & MARKED]
        self.all = regression([masks[i] for i in unmarked], [labels[i] for i in unmarked], STRUCTURE + WORDING)
        names = set(inside) | set(outside)
        odds = {t: np.log((inside[t] + 1) / (inside.total() + len(names))) - np.log((outside[t] + 1) / (outside.total() + len(names))) for t in names}
        self._known: dict[int, tuple[float, bool]] = {}
        # Tags cost something wherever they stand; how much beside words is what serves the labelled pages best.
        tried = []
        for scale in (0.1, 0.25, 0.5, 1.0, 2.0):
            self.tags = {t: min(-0.01, scale * float(o)) for t, o in odds.items()}
            self.tag = min(-0.01, -0.1 * scale)
            right = total = 0
            for page, wanted in read:
                kept = set(map(id, self.kept(page)))
                both = sum(i[4] for i, label in wanted if label and id(i) in kept)
                right += 2 * both
                total += sum(i[4] for i, label in wanted if label) + sum(i[4] for i, _ in wanted if id(i) in kept)
            tried.append((right / total, self.tags, self.tag))
        # The mildest of those that hardly differ: nothing but furniture is to be lost.
        best = max(t[0] for t in tried) - 0.001
        self.f1, self.tags, self.tag = next(t for t in tried if t[0] >= best)

    def of(self, mask: int) -> tuple[float, bool]:
        """(score of a word, whether it isn't furniture) with these features."""
        if mask not in self._known:
            on = [i for i in range(len(BIT)) if mask >> i & 1]
            structure = float(self.structure[[i for i in on if i < len(STRUCTURE)]].sum() + self.structure[-1])
            score = structure if mask & MARKED else float(self.all[on].sum() + self.all[-1])
            self._known[mask] = max(0.0, score) if structure >= 0 else 0.0, structure >= 0
        return self._known[mask]

    def scores(self, page: Page) -> list[float]:
        """The score of each item: of all its words, or of the tag."""
        return [self.of(i[2])[0] * i[4] if i[0] == TEXT else self.tags.get(_tag_key(i[1], i[2]), self.tag) for i in page.items]

    def kept(self, page: Page) -> list[tuple]:
        """The text nodes of the main text."""
        first, last = best_run(self.scores(page))
        run = page.items[first:last] if last else page.items
        return [i for i in run if i[0] == TEXT and self.of(i[2])[1]]


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the greatest sum, the shortest of the first ones; (0, 0) if none is positive."""
    total, best, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


_learned: Weights | None = None


def learned() -> Weights:
    """The weights, learned once in a process."""
    global _learned
    if _learned is None:
        _learned = Weights(labelled_pages())
    return _learned


def main_text(html: str, weights: Weights | None = None) -> str:
    weights = weights or learned()
    page = Page(html)
    kept = set(map(id, weights.kept(page)))
    parts = [(i[1] if id(i) in kept else " ") if i[0] == TEXT else " " if i[1] in BLOCKS or i[1] == "br" else "" for i in page.items]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars)."""
    lean(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    weights = learned()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{key} {rows.schema['key'].dataType.simpleString()}, url string, text string, n_chars long")
