"""Labelled pages to train the extractor on, made from page parts.

Each page is laid out from parts whose role is known: the article's own
blocks are labelled 1, everything else 0.  Words are made up, so a model learns
from structure, names and the shape of text.  Pages vary in containers, naming,
order, nesting and missing end tags.
"""

from __future__ import annotations

import random

SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve zo kan lor mir sel tun ver ond ent ion ing ter al ".split(" ")


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 2, 2, 3)))) or "a"


def _phrase(r: random.Random, a: int, b: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(a, b)))


def _style(r: random.Random):
    """How a page's sentences look: plain, loud, with symbols, or as cells."""
    kind = r.choice(("plain", "plain", "plain", "loud", "symbols", "bars"))

    def sentence() -> str:
        words = _phrase(r, 3, 14).split()
        if kind == "loud":
            return " ".join(w.upper() + "!!" for w in words)
        if kind == "symbols":
            return " ".join(w + r.choice(("***", "###", "%%%", "&amp;&amp;&amp;", "$$$")) for w in words)
        if kind == "bars":
            return " | ".join(words)
        return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?", ";"))

    return sentence


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.out, self.labels, self.sentence = r, [], [], _style(r)

    def raw(self, s: str) -> None:
        self.out.append(s)

    def block(self, tag: str, text: str, label: int, attrs: str = "", link: bool = False, close: bool = True) -> None:
        inner = f'<a href="/{_word(self.r)}">{text}</a>' if link else text
        self.out.append(f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if close else ""))
        self.labels.append(label)

    def named(self, *names: str) -> str:
        name = self.r.choice(names)
        if self.r.random() < 0.5:
            name += self.r.choice(("-box", "_wrap", " col", "-1", ""))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def links(self, tag: str, attrs: str, n: int) -> None:
        r = self.r
        self.raw(f"<{tag}{attrs}>" + ("<ul>" if (listed := r.random() < 0.7) else ""))
        for _ in range(n):
            self.block("li" if listed else r.choice(("div", "p")), _phrase(r, 1, 3), 0, link=True)
        self.raw(("</ul>" if listed else "") + f"</{tag}>")

    def paragraph(self, label: int, a: int = 1, b: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    # parts that are not the article
    def menu(self):
        tag = self.r.choice(("nav", "nav", "div", "header"))
        self.links(tag, "" if tag == "nav" and self.r.random() < 0.6 else self.named("menu", "navbar", "nav", "navigation", "breadcrumb", "topbar"), self.r.randint(3, 9))

    def header(self):
        tag = self.r.choice(("header", "header", "div"))
        self.raw(f"<{tag}{self.named('header', 'masthead', 'banner', 'site-header') if tag == 'div' or self.r.random() < 0.4 else ''}>")
        self.block(self.r.choice(("div", "h1", "p", "span")) if tag == "header" else "div", _phrase(self.r, 1, 4).title(), 0)
        if self.r.random() < 0.5:
            self.block("p", self.sentence(), 0)
        self.raw(f"</{tag}>")

    def advert(self):
        tag = self.r.choice(("div", "div", "aside", "section"))
        self.raw(f"<!-- ad {self.r.randint(0, 99)} -->")
        attrs = self.named("ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor")
        if self.r.random() < 0.5:
            self.block(tag, self.paragraph(0, 1, 2), 0, attrs)
        else:
            self.raw(f"<{tag}{attrs}>")
            self.block("p", self.paragraph(0, 1, 3), 0)
            self.raw(f"</{tag}>")

    def sidebar(self):
        tag = self.r.choice(("aside", "aside", "div", "section"))
        self.raw(f"<{tag}{self.named('sidebar', 'side', 'widget', 'related', 'aside', 'recommended', 'trending', 'popular') if tag != 'aside' or self.r.random() < 0.5 else ''}>")
        self.block(self.r.choice(("h2", "h3", "h4", "div")), _phrase(self.r, 1, 3).title(), 0)
        for _ in range(self.r.randint(1, 5)):
            self.block(self.r.choice(("li", "p", "div")), self.sentence(), 0, link=self.r.random() < 0.6)
        if self.r.random() < 0.4:
            self.block("p", self.paragraph(0, 2, 4), 0)
        self.raw(f"</{tag}>")

    def notice(self):
        tag = self.r.choice(("div", "div", "section", "aside", "dialog"))
        self.raw(f"<{tag}{self.named('cookie', 'cookie-notice', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'newsletter', 'paywall', 'banner', 'disclaimer', 'overlay')}>")
        self.block(self.r.choice(("p", "span", "div")) if self.r.random() < 0.8 else "div", self.paragraph(0, 1, 3), 0)
        if self.r.random() < 0.6:
            self.block("button", _phrase(self.r, 1, 2), 0)
        self.raw(f"</{tag}>")

    def form(self):
        self.raw(f"<form{self.named('search', 'login', 'subscribe', 'signup', 'newsletter', 'contact') if self.r.random() < 0.5 else ''}>")
        for _ in range(self.r.randint(1, 4)):
            self.block(self.r.choice(("label", "p", "div", "button", "legend")), _phrase(self.r, 1, 5), 0)
            if self.r.random() < 0.2:
                self.block("textarea", _phrase(self.r, 1, 5), 0)
            self.raw('<input type="text">')
        self.raw("</form>")

    def fallback(self):
        """What shows where scripts or plug-ins don't run."""
        tag = self.r.choice(("noscript", "noscript", "object", "iframe"))
        if self.r.random() < 0.5:
            self.block(tag, _phrase(self.r, 2, 8).capitalize() + ".", 0)
        else:
            self.raw(f"<{tag}>")
            self.block("p", _phrase(self.r, 2, 8).capitalize() + ".", 0, link=self.r.random() < 0.3)
            self.raw(f"</{tag}>")

    def share(self):
        self.links("div", self.named("share", "social", "tags", "share-buttons", "toolbar", "pagination", "pager", "meta"), self.r.randint(1, 5))

    def comments(self):
        tag = self.r.choice(("section", "div", "div", "ol", "ul"))
        inner = "li" if tag in ("ol", "ul") else self.r.choice(("div", "article", "p"))
        self.raw(f"<{tag}{self.named('comments', 'comment-list', 'comments', 'discussion', 'replies', 'responses', 'disqus', 'reader-comments')}>")
        if inner != "li" and self.r.random() < 0.6:
            self.block(self.r.choice(("h2", "h3")), _phrase(self.r, 1, 3), 0)
        for _ in range(self.r.randint(1, 5)):
            attrs = self.named("comment", "reply", "comment-body") if self.r.random() < 0.6 else ""
            if inner == "p" or self.r.random() < 0.4:
                self.block(inner, self.paragraph(0, 1, 4), 0, attrs)
            else:
                self.raw(f"<{inner}{attrs}>")
                if self.r.random() < 0.5:
                    self.block("div", _phrase(self.r, 1, 2), 0, self.named("author", "user", "meta"))
                self.block("p", self.paragraph(0, 1, 4), 0)
                self.raw(f"</{inner}>")
        self.raw(f"</{tag}>")

    def footer(self):
        tag = self.r.choice(("footer", "footer", "footer", "div"))
        attrs = self.named("footer", "site-footer", "bottom", "copyright", "legal") if tag == "div" or self.r.random() < 0.3 else ""
        if self.r.random() < 0.5:
            self.block(tag, f"&copy; {_word(self.r)}.example &middot; {self.paragraph(0, 1, 2)}", 0, attrs)
        else:
            self.raw(f"<{tag}{attrs}>")
            for _ in range(self.r.randint(1, 4)):
                self.block(self.r.choice(("p", "li", "div")), self.r.choice(("&copy; 2020 ", "")) + _phrase(self.r, 1, 8), 0, link=self.r.random() < 0.4)
            self.raw(f"</{tag}>")

    # the article
    def article(self, inserts: list) -> None:
        r = self.r
        tags = r.choice((("article",), ("article",), ("article",), ("main",), ("main", "article"), ("div",), ("section",), ("main", "div"), ("div", "div"), ("article", "div")))
        opened = []
        for t in tags:
            if t in ("div", "section"):
                a = self.named("content", "post", "entry-content", "article", "article-body", "story", "post-body", "main", "text", "body-text", "page-content") if r.random() < 0.85 else ""
            else:
                a = self.named("content", "post", "article", "main", "hentry") if r.random() < 0.3 else ""
            self.raw(f"<{t}{a}>")
            opened.append(t)
        if r.random() < 0.85:
            in_header = r.random() < 0.15
            self.raw("<header>" if in_header else "")
            self.block("h1", self.sentence()[: r.randint(20, 80)].rsplit("&", 1)[0] or "a", 1)
            self.raw("</header>" if in_header else "")
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.62:
                self.block("p", self.paragraph(1), 1, close=r.random() < 0.85)
            elif kind < 0.72:  # bold text cut by a line break, never closed
                self.raw("<p><b>")
                self.raw(self.paragraph(1))
                self.labels.append(1)
                self.raw("<br>")
            elif kind < 0.8:
                self.block(r.choice(("h2", "h3", "h4")), _phrase(r, 1, 6).capitalize(), 1)
            elif kind < 0.87:
                self.raw(t := r.choice(("<ul>", "<ol>")))
                for _ in range(r.randint(1, 4)):
                    self.block("li", self.sentence(), 1)
                self.raw(t.replace("<", "</"))
            elif kind < 0.93:
                self.block(r.choice(("blockquote", "pre", "div", "figcaption")), self.paragraph(1, 1, 3), 1)
            elif kind < 0.96:  # the article's own text, for readers without scripts or plug-ins
                self.raw(f"<{(t := r.choice(('noscript', 'object')))}>")
                self.block("p", self.paragraph(1, 2, 5), 1)
                self.raw(f"</{t}>")
            elif inserts:
                r.choice(inserts)()
        for t in reversed(opened):
            self.raw(f"</{t}>")


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """HTML and the label of each of its leaf blocks."""
    r = random.Random(seed)
    p = _Page(r)
    p.raw('<!DOCTYPE html><html><head><meta charset="utf-8"><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
    before = [p.menu, p.header, p.advert, p.notice, p.form, p.sidebar, p.fallback]
    after = [p.comments, p.sidebar, p.share, p.advert, p.form, p.notice, p.menu, p.fallback]
    for part in r.sample(before, r.randint(0, 4)):
        part()
    p.article([p.advert, p.share, p.sidebar, p.form, p.notice] if r.random() < 0.5 else [])
    for part in r.sample(after, r.randint(0, 4)):
        part()
    if r.random() < 0.8:
        p.footer()
    if r.random() < 0.8:
        p.raw("</body></html>")
    return "".join(p.out), p.labels
