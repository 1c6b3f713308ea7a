"""Pages to learn from: made up, of many layouts, with the truth about each node.

Each element that is a menu, header, advert, comment and so on carries the attribute
``data-truth="0"``, each that belongs to the article ``"1"``; ``dom.parse`` takes the mark
off again before features are made.
"""

from __future__ import annotations

import random

PAGES = 800
LETTERS = "aeiouaeionrtlsdmcbgvfhpáéñüö"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.foreign = 0.0  # of the page that is being made: how often a name says nothing

    def word(self) -> str:
        return "".join(self.r.choice(LETTERS) for _ in range(self.r.randint(1, 9)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(lo, hi)):
            s = self.words(1, 25).capitalize()
            if r.random() < 0.5 and " " in s:
                s = s.replace(" ", ", ", 1)
            out.append(s + r.choice(["...", "."] if r.random() < 0.1 else [".", ".", "!", "?"]))
        return " ".join(out)

    def attrs(self, names: list[str], often: float = 0.85) -> str:
        r = self.r
        if r.random() > often:
            return ""
        # sites that name things in another language, by a code, or for their looks
        foreign = r.random() < self.foreign
        name = r.choice(["x", "c", "css-", "sc-", "_"]) + f"{r.randint(1, 99)}" if foreign and r.random() < 0.5 else r.choice(["box", "bloc", "caja", "kasten", "inner", "col-8", "mt-4", self.word()]) if foreign else r.choice(names)
        if r.random() < 0.3:
            name = r.choice(["site-", "page-", "main-", "js-", "c-"]) + name
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def tag(self, tag: str, inner: str, truth: str = "", attrs: str = "") -> str:
        mark = f' data-truth="{truth}"' if truth else ""
        return f"<{tag}{attrs}{mark}>{inner}</{tag}>"

    def links(self, n: int, sep: bool) -> str:
        r = self.r
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]
        if sep:
            return r.choice([" | ", " ", " · "]).join(items)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def menu(self) -> str:
        r = self.r
        body = self.links(r.randint(3, 10), r.random() < 0.3)
        return self.tag("nav", body, "0", self.attrs(["nav", "menu"], 0.4)) if r.random() < 0.6 else self.tag("div", body, "0", self.attrs(["nav", "menu", "navbar", "topnav", "breadcrumb", "links"]))

    def header(self) -> str:
        r = self.r
        body = f"<{(h := r.choice(['h1', 'h2', 'div', 'p']))}>{self.words(1, 6)}</{h}>" + (self.menu() if r.random() < 0.5 else "") + (f"<p>{self.words(2, 8)}</p>" if r.random() < 0.4 else "")
        return self.tag("header", body, "0") if r.random() < 0.6 else self.tag("div", body, "0", self.attrs(["header", "masthead", "banner", "top"], 1))

    def footer(self) -> str:
        r = self.r
        body = f"© {self.word()}.example · {self.sentences(1, 3)}" if r.random() < 0.6 else f"<p>© 20{r.randint(10, 30)} {self.words(1, 4)}</p>" + self.links(r.randint(2, 6), True)
        return self.tag("footer", body, "0") if r.random() < 0.65 else self.tag("div", body, "0", self.attrs(["footer", "copyright", "legal", "bottom"], 1))

    def advert(self) -> str:
        body = self.sentences(1, 2) if self.r.random() < 0.6 else f"<p>{self.sentences(1, 2)}</p><a href='/x'>{self.words(1, 3)}</a>"
        return self.tag(self.r.choice(["div", "div", "aside", "section", "ins"]), body, "0", self.attrs(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-box", "banner-ad", "teaser"], 1))

    def notice(self) -> str:
        body = f"<p>{self.sentences(1, 3)}</p>" + (f"<button>{self.word()}</button>" if self.r.random() < 0.7 else "")
        return self.tag(self.r.choice(["div", "div", "section", "aside"]), body, "0", self.attrs(["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "newsletter", "subscribe", "paywall", "disclaimer"], 1))

    def sidebar(self) -> str:
        r = self.r
        body = f"<h3>{self.words(1, 4)}</h3>" + (self.links(r.randint(3, 9), False) if r.random() < 0.7 else f"<p>{self.sentences(1, 3)}</p>")
        return self.tag("aside", body, "0", self.attrs(["sidebar"], 0.5)) if r.random() < 0.6 else self.tag("div", body, "0", self.attrs(["sidebar", "related", "widget", "popular", "tags", "share", "social", "recommend"], 1))

    def form(self) -> str:
        r = self.r
        body = "".join(f"<label>{self.words(1, 3)}</label><input name='{self.word()}'>" for _ in range(r.randint(1, 4))) + f"<button>{self.words(1, 2)}</button>" + (f"<p>{self.sentences(1, 1)}</p>" if r.random() < 0.3 else "")
        return self.tag("form", body, "0", self.attrs(["search", "login", "contact", "form"], 0.5))

    def comments(self) -> str:
        r = self.r
        kind, named, said = r.choice(["li", "div", "article"]), r.choice(["b", "a", "cite", "strong", "span"]), r.choice(["p", "p", "div"])
        date = r.random() < 0.4
        one = lambda: self.tag(kind, f"<{named}>{self.words(1, 2)}</{named}>" + (f" <time>{r.randint(1, 28)} {self.word()} 20{r.randint(10, 30)}</time>" if date else "") + f" <{said}>{self.sentences(1, 4)}</{said}>", "", self.attrs(["comment", "reply", "comment-body"], 0.8))
        body = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        return self.tag(r.choice(["section", "div", "ol", "ul"]), body, "0", self.attrs(["comments", "comment-list", "discussion", "responses", "disqus", "replies"], 1))

    def paragraph(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.72:
            s = self.sentences(1, 8)
            if r.random() < 0.25:
                s += f' <a href="/{self.word()}">{self.words(1, 4)}</a> {self.sentences(1, 2)}'
            if r.random() < 0.15:
                s = f"<b>{s}</b>"
            if r.random() < 0.1:
                s += "<br>" + self.sentences(1, 2)
            return f"<p>{s}</p>"
        if k < 0.8:
            return f"<p>{self.words(1, 3).capitalize()}.</p>"
        if k < 0.87:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{self.words(1, 7)}</{h}>"
        if k < 0.92:
            return "<ul>" + "".join(f"<li>{self.sentences(1, 1)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if k < 0.95:
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"
        if k < 0.955:
            return f"<table><tr><td>{self.words(1, 12)}</td></tr></table>"
        if k < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<div>{self.sentences(1, 5)}</div>" if k < 0.985 else f"<figure><img src='x'><figcaption>{self.sentences(1, 1)}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        kind = r.random()
        headline = f"<h1>{self.words(1, 10)}</h1>"
        if kind < 0.65 and r.random() < 0.2:  # a header that only article or main tells from the page's
            headline = self.tag("header", headline + (f"<p>{self.words(1, 8)}</p>" if r.random() < 0.5 else ""), "1")
        parts = [headline] if r.random() < 0.85 else []
        short = r.random() < 0.12
        parts += [f"<p>{self.words(3, 14).capitalize()}.</p>"] if short else [self.paragraph() for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20]))]
        if r.random() < 0.3:  # what interrupts an article
            parts.insert(r.randint(1, len(parts)), r.choice([self.advert, self.sidebar, self.notice])())
        if r.random() < 0.25:
            parts.append(r.choice([self.comments, self.comments, self.sidebar, self.form])())
        if kind < 0.5:
            return self.tag("article", "".join(parts), "1", self.attrs(["article", "post", "entry"], 0.3))
        if kind < 0.65:
            return self.tag("main", "".join(parts), "1")
        return self.tag(r.choice(["div", "section"]), "".join(parts), "1", self.attrs(["content", "post", "entry-content", "article-body", "story", "text", "post-body", "main"], 0.85))

    def bare(self) -> str:
        """Nothing but an article, in the body itself."""
        r = self.r
        k = r.random()
        if k < 0.3:
            inner = r.choice(["<br>", "<br><br>", "\n\n"]).join(self.sentences(1, 6) for _ in range(r.randint(1, 6)))
        else:
            inner = "".join(self.paragraph() for _ in range(r.choice([1, 2, 3, 5, 8])))
            if r.random() < 0.5:
                inner = f"<h1>{self.words(1, 8)}</h1>" + inner
        return f'<body data-truth="1">{inner}</body>'

    def tabled(self, top: list[str], middle: str, end: list[str]) -> str:
        """A page laid out as a table: a cell for each part."""
        cell = lambda x: f"<td>{x}</td>"
        rows = "".join(f"<tr>{cell(x)}</tr>" for x in top) + "<tr>" + (cell(self.sidebar()) if self.r.random() < 0.6 else "") + cell(middle) + "</tr>" + "".join(f"<tr>{cell(x)}</tr>" for x in end)
        return f"<table>{rows}</table>"

    def page(self) -> str:
        """One page; some leave out end tags that HTML lets them leave out."""
        self.foreign = self.r.choice([0, 0, 0, 0, 0, 0, 0.5, 1])
        html = self.bare() if self.r.random() < 0.06 else self.whole()
        if self.r.random() < 0.12:
            for tag in ("p", "li", "td", "tr", "dd"):
                html = html.replace(f"</{tag}>", "")
        return html

    def whole(self) -> str:
        r = self.r
        body = []
        top = [f() for f, p in ((self.header, 0.5), (self.menu, 0.8), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.2)) if r.random() < p]
        end = [f() for f, p in ((self.sidebar, 0.4), (self.comments, 0.35), (self.form, 0.15), (self.advert, 0.25), (self.notice, 0.15), (self.footer, 0.85)) if r.random() < p]
        r.shuffle(top)
        middle = self.article()
        if r.random() < 0.15:
            middle = self.sidebar() + middle
        if r.random() < 0.4:
            if r.random() < 0.5 and end:
                middle += end.pop(0)
            middle = self.tag(r.choice(["div", "div", "main", "section"]), middle, "", self.attrs(["wrapper", "container", "page", "main", "row", "layout"], 0.7))
        body = [self.tabled(top, middle, end)] if r.random() < 0.08 else [*top, middle, *end]
        return f"<html><head><title>{self.words(1, 6)}</title></head><body>{''.join(body)}</body></html>"


def pages(n: int = PAGES, seed: int = 5) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
