"""Labelled pages, made by rule, from which the weights of HTML extraction are learned.

A page is a list of (label, markup) pieces in page order; label 1 marks main text.  Pages come
with and without an article or main element, with named and nameless furniture, and with names
that mislead: wrappers called after a sidebar that they don't have, and main text in elements
whose class sounds like furniture.
"""

from __future__ import annotations

import random

#: Class names of furniture, by what stands in it.
FURNITURE_NAMES = {
    "ads": "ad ads advert ad-slot ad-box advertisement sponsored ad-banner adv-wrapper sponsor-box ad-300 leader-ad sticky-ads",
    "comments": "comments comment-list comments-area commentlist discussion replies comment comment-body post-comments user-comments reply-form",
    "nav": "nav menu navbar main-navigation breadcrumbs pagination toolbar site-menu main-nav navigation-bar top-menu skip-link secondary-navigation mobile-menu nav-primary",
    "side": "sidebar sidebar-left widget widgets widget-area right-rail page-sidebar blog-sidebar sidebar-primary",
    "foot": "footer site-footer copyright page-footer legal colophon footer-credits copyright-line",
    "top": "header site-header masthead topbar page-header",
    "share": "share social share-buttons social-links sharing follow-us share-bar post-share",
    "cookie": "cookie-notice cookies consent gdpr cookie-banner cookie-consent gdpr-popup cookie-law-info cookie-message",
    "notice": "notice alert notice-box alert-box popup modal overlay warning modal-box",
    "promo": "newsletter promo subscribe signup newsletter-box promotion subscribe-form promo-box newsletter-teaser newsletter-optin email-subscribe",
    "related": "related recommended related-posts related-links recommendations teasers related-articles",
    "form": "search login search-form login-box searchbox form form-box",
}
#: Class names of main text; the first ones sound like nothing, the others like furniture.
PLAIN_NAMES = "content story text body entry post column c1 x lead intro section".split()
MISLEADING_NAMES = "search-title related-work alert-list login-flow form-letters social-history menu-card widget-maker promo-song notice-period warning-signs header-image entry-header post-header related-facts search-tree form-of-address popup-shop overlay-network alert-level".split()
MISLEADING_SMALL = "note form alert menu header search related widget notice warning legal promo discussion social".split()
WRAPPER_NAMES = "no-sidebar has-sidebar with-sidebar search-results-page layout-sidebar page-with-menu has-cookie-notice ads-free single-comments-open header-fixed".split()
SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti vo an el is ur ne ka to".split()
STOCK = {
    "ads": ["Cheap shoes today", "Buy two and get one free.", "Try our new phones for a month, no strings attached.", "Advertisement"],
    "comments": ["I like this very much", "Thanks for writing this, it made my day.", "First!", "You forgot the most important thing, as always."],
    "nav": ["Home", "News", "About us", "Sport", "Older", "Page 2", "Contact"],
    "side": ["Popular today", "Our team writes about the world and all that is in it.", "Archive", "Latest news"],
    "foot": ["All rights reserved", "Imprint", "© 2024 The Company", "Copyright by the authors. No part may be used without consent.", "Privacy policy"],
    "top": ["The Daily Page", "Menu", "Since 1900"],
    "share": ["Share", "Tell your friends", "Follow us on every network.", "Tweet"],
    "cookie": ["We use cookies to make this page better.", "Accept all", "This site stores data in your browser. You can read more in our policy."],
    "notice": ["This site will be down on Sunday.", "Your browser is too old", "Please update your settings to go on."],
    "promo": ["Subscribe to our newsletter", "Get the best stories in your mail every week.", "Sign up now"],
    "related": ["You may also like", "Ten things to know", "More on this topic"],
    "form": ["Your name", "Search", "Send", "Password"],
}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.pieces = rng, []

    def add(self, label: int, markup: str):
        self.pieces.append((label, markup))

    def pick(self, listed):
        return self.rng.choice(listed)

    def chance(self, odds: float) -> bool:
        return self.rng.random() < odds

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3))))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(a, b)))

    def sentence(self) -> str:
        text = self.words(4, 18).split()
        for tag in ("b", "i", "a href='/w'", "em"):
            if self.chance(0.12):
                i = self.rng.randrange(len(text))
                text[i] = f"<{tag}>{text[i]}</{tag.split()[0]}>"
        return " ".join(text) + self.pick(".....!?")

    def name(self, classes: str) -> str:
        return f' {self.pick(("class", "class", "id"))}="{classes}"'

    # main text

    def paragraph(self, marked: bool):
        text = " ".join(self.sentence() for _ in range(self.pick((1, 2, 4, 6)))) if self.chance(0.85) else self.words(1, 6)
        small = self.name(self.pick(MISLEADING_SMALL)) if marked and self.chance(0.25) else ""
        tag = "p" if marked or self.chance(0.8) else "div"
        self.add(1, f"<{tag}{small}>{text}</{tag}>" if self.chance(0.9) or tag == "div" else f"<{tag}{small}>{text}")

    def story(self, marked: bool):
        if self.chance(0.8):
            head = f"<h1>{self.words(2, 8)}</h1>"
            if marked and self.chance(0.3):
                head = f"<{(t := self.pick(('header', 'div class=header', 'div class=entry-header')))}>{head}<p>{self.words(2, 5)}</p></{t.split()[0]}>"
            self.add(1, head)
        for _ in range(self.pick((1, 2, 3, 5, 8))):
            kind = self.rng.random()
            if kind < 0.6:
                self.paragraph(marked)
            elif kind < 0.68:
                small = self.name(self.pick(MISLEADING_NAMES)) if marked and self.chance(0.4) else ""
                self.add(1, f"<h2{small}>{self.words(1, 6)}</h2>")
                self.paragraph(marked)
            elif kind < 0.75:
                linked = marked and self.chance(0.4)
                items = "".join(f"<li>{f'<a href=/r>{t}</a>' if linked else t}</li>" for t in (self.words(1, 6) if self.chance(0.5) else self.sentence() for _ in range(self.rng.randint(2, 5))))
                self.add(1, f"<ul>{items}</ul>")
                self.paragraph(marked)
            elif kind < 0.8:
                self.add(1, f"<blockquote>{self.sentence()}</blockquote>")
            elif kind < 0.84:
                self.add(1, f"<figure><img src=x><figcaption>{self.words(3, 9)}</figcaption></figure>")
            elif kind < 0.88:
                self.add(1, "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 2)}</td></tr>" for _ in range(3)) + "</table>")
                self.paragraph(marked)
            elif kind < 0.94 and marked:
                self.add(1, f"<{(t := self.pick(('div', 'section')))}{self.name(' '.join({self.pick(MISLEADING_NAMES) for _ in range(2)}))}>{f'<p>{self.words(2, 5)}</p>' if self.chance(0.5) else self.sentence()}</{t}>")
            else:
                self.furniture(self.pick(("ads", "ads", "share", "promo", "related", "notice", "form", "side", "nav", "foot", "cookie")), inside=True)
                self.paragraph(marked)

    # furniture

    def furniture(self, family: str, inside: bool = False):
        element = self.pick({"nav": ["nav", "nav", "menu"], "foot": ["footer"], "top": ["header"], "side": ["aside"], "form": ["form", "form", "fieldset", "button"], "notice": ["dialog", None], "promo": ["aside", None, "form"], "related": ["aside", "nav", None], "ads": ["aside", None, None]}.get(family, [None]))
        if inside and element == "header":
            element = None
        named = not element or self.chance(0.5)
        small = self.chance(0.1) and not element
        tag = element if element and (not named or self.chance(0.3)) else self.pick(("p", "span")) if small else self.pick(("div", "div", "section", "ul" if family in ("nav", "share") else "div"))
        name = self.name(self.pick(FURNITURE_NAMES[family].split())) if named else ""
        if self.chance(0.08):
            tag, name = "div", self.pick((" hidden", ' aria-hidden="true"', ' style="display:none"'))
        if small or element == "button":
            self.add(0, f"<{tag}{name}>{self.pick(STOCK[family])}</{tag}>")
            return
        texts = [self.pick(STOCK[family]) for _ in range(self.rng.randint(4, 8) if family == "nav" else self.rng.randint(1, 4))]
        self.add(0, f"<{tag}{name}>{self.inner(texts, family)}</{tag}>")

    def inner(self, texts: list[str], family: str) -> str:
        links = family in ("nav", "related") or family in ("foot", "share", "side") and self.chance(0.5)
        if links:
            texts = [f"<a href='/{i}'>{t}</a>" for i, t in enumerate(texts)]
        if links and self.chance(0.6):
            return ("<h3>" + self.words(1, 3) + "</h3>") * self.chance(0.3) + "<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>"
        if family in ("comments", "side", "promo") and self.chance(0.7):
            return "".join(f"<p>{t}</p>" for t in texts) + f"<p>{self.sentence()}</p>" * self.chance(0.5)
        if family == "form":
            return " ".join(f"<label>{t}</label><input>" for t in texts) + f"<button>{texts[0]}</button>"
        return " ".join(texts)

    def bare_furniture(self, family: str):
        """Furniture without any name."""
        texts = [self.pick(STOCK[family]) for _ in range(self.rng.randint(1, 6))]
        if family in ("nav", "foot") and self.chance(0.6):
            texts = [f"<a href='/{i}'>{t}</a>" for i, t in enumerate(texts)]
            self.add(0, "<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>" if self.chance(0.5) else "<div>" + self.pick((" ", " | ", "")).join(texts) + "</div>" if self.chance(0.6) else "<table><tr>" + "".join(f"<td>{t}</td>" for t in texts) + "</tr></table>")
        else:
            self.add(0, "".join(f"<div>{t}</div>" for t in texts))


def labelled_pages(count: int = 400, seed: int = 11) -> list[list[tuple[int, str]]]:
    out = []
    for i in range(count):
        w = _Writer(random.Random(seed * 1_000_003 + i))
        kind = i % 4  # 0, 1: with article or main; 2: named furniture only; 3: nothing has a name
        wrapper = w.name(w.pick(WRAPPER_NAMES)) if w.chance(0.3) else ""
        w.add(0, f"<html><head><title>{w.words(2, 5)}</title></head><body{wrapper}>")
        if w.chance(0.4):
            w.add(0, f"<div{w.name(w.pick(WRAPPER_NAMES))}>" if w.chance(0.5) else "<div>")
        if kind == 3:
            for family in ("nav", "top", "nav")[: w.rng.randint(0, 3)]:
                w.bare_furniture(family)
            w.add(0, w.pick(("<div>", "", "<table><tr><td>", "<section>")))
            w.story(False)
            w.add(0, w.pick(("</div>", "")))
            for family in ("nav", "foot", "foot")[: w.rng.randint(0, 3)]:
                w.bare_furniture(family)
        else:
            for family in ("cookie", "top", "nav", "ads", "notice", "form", "top"):
                if w.chance(0.45):
                    w.furniture(family)
            if kind == 2:
                w.add(0, f"<div{w.name(w.pick(PLAIN_NAMES))}>" if w.chance(0.7) else "<div>")
                w.story(False)
                w.add(0, "</div>")
            else:
                first, last = w.pick((("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<article class='post has-sidebar'>", "</article>"), ("<div role='main'>", "</div>")))
                if w.chance(0.15):
                    w.bare_furniture(w.pick(("ads", "side", "top", "nav")))
                w.add(0, first)
                w.story(True)
                if w.chance(0.3):
                    w.furniture(w.pick(("comments", "share", "related", "foot", "side", "nav")), inside=True)
                w.add(0, last)
                if w.chance(0.3):
                    w.bare_furniture(w.pick(("side", "promo", "related", "comments")))
            for family in ("comments", "share", "related", "side", "promo", "ads", "form", "foot", "nav"):
                if w.chance(0.4):
                    w.furniture(family)
        w.add(0, "</body></html>")
        out.append(w.pieces)
    return out
