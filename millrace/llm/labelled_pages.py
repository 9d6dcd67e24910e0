"""Labelled web pages to train the extractor on: invented text in many layouts, each block known to be article or not."""

from __future__ import annotations

import random

#: Names that sites give to parts of a page: (inside the article, outside it).
ARTICLE_NAMES = ["content", "post-body", "entry-content", "article-text", "story", "main-text", "post", "body-copy", "page-content", "text"]
ASIDE_NAMES = {
    "ad": ["ad", "ads", "advert", "sponsored", "banner-ad", "promo"],
    "notice": ["cookie-notice", "notice", "gdpr", "consent", "alert-bar", "popup"],
    "sidebar": ["sidebar", "related", "widget", "recommended", "most-read", "rail"],
    "comments": ["comments", "comment-list", "responses", "replies", "discussion", "comment"],
    "share": ["share", "social", "share-bar", "follow-us", "tools"],
    "crumbs": ["breadcrumb", "breadcrumbs", "crumbs", "path"],
    "form": ["newsletter", "signup", "search-form", "login", "subscribe"],
    "menu": ["menu", "navbar", "top-nav", "nav", "site-nav"],
    "header": ["header", "masthead", "site-header", "topbar"],
    "footer": ["footer", "site-footer", "bottom", "legal", "copyright"],
}


class Page:
    def __init__(self, rnd: random.Random) -> None:
        self.rnd = rnd
        self.html: list[str] = []
        self.labels: list[int] = []
        self.words = ["".join(rnd.choice("abcdefghilmnoprstuväéñß") for _ in range(rnd.randint(1, 9))) for _ in range(150)]

    def sentence(self, low: int, high: int, end: str = ".") -> str:
        words = [self.rnd.choice(self.words) for _ in range(self.rnd.randint(low, high))]
        for k in range(len(words)):
            if self.rnd.random() < 0.07:
                words[k] += ","
        return " ".join(words).capitalize() + end

    def prose(self, low: int = 1, high: int = 6) -> str:
        r = self.rnd
        if r.random() < 0.06:  # words with marks, or in capitals
            mark = r.choice(["%%%", "&amp;&amp;&amp;", "***", "!!", "$$$"])
            return " ".join(w + mark for w in self.sentence(5, 40).split())
        text = " ".join(self.sentence(3, 22) for _ in range(r.randint(low, high)))
        if r.random() < 0.15:
            text = f"<b>{text}</b>" if r.random() < 0.7 else f"<b>{text}"
        if r.random() < 0.2:
            text += f' <a href="/x">{self.sentence(1, 4, "")}</a> {self.sentence(2, 8)}'
        return text

    def block(self, text: str, label: int, tag: str = "p") -> None:
        self.html.append(f"<{tag}>{text}</{tag}>" if tag not in ("p", "li") or self.rnd.random() < 0.85 else f"<{tag}>{text}")
        self.labels.append(label)

    def links(self, n: int) -> None:
        self.html.append("<ul>")
        for _ in range(n):
            self.html.append(f'<li><a href="/y">{self.sentence(1, 3, "")}</a></li>')
            self.labels.append(0)
        self.html.append("</ul>")

    def named(self, kind: str) -> str:
        r = self.rnd
        tags = {"menu": ["nav", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div"], "comments": ["section", "div", "ol"], "form": ["form", "div"]}.get(kind, ["div", "section"])
        tag = r.choice(tags)
        if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6:
            return tag
        return f'{tag} {r.choice(["class", "id"])}="{r.choice(ASIDE_NAMES[kind])}"'

    def part(self, kind: str) -> None:
        r, name = self.rnd, self.named(kind)
        self.html.append(f"<{name}>")
        if kind in ("menu", "crumbs", "share"):
            self.links(r.randint(2, 8))
        elif kind == "header":
            self.block(self.sentence(1, 4, ""), 0, r.choice(["h1", "div", "p", "span"]) if r.random() < 0.8 else "h2")
            if r.random() < 0.5:
                self.links(r.randint(2, 6))
        elif kind == "footer":
            self.html.append(f"&copy; {r.choice(self.words)}.example.com &middot; {self.sentence(2, 12)}")
            self.labels.append(0)
            if r.random() < 0.3:
                self.links(r.randint(1, 4))
        elif kind == "sidebar":
            self.block(self.sentence(1, 3, ""), 0, r.choice(["h2", "h3", "h4"]))
            self.links(r.randint(2, 6)) if r.random() < 0.6 else self.block(self.prose(1, 2), 0)
        elif kind == "form":
            self.block(self.sentence(2, 9), 0, r.choice(["p", "label", "h3", "div"]))
            self.html.append('<input type="text" name="q">')
        elif kind == "comments":
            if r.random() < 0.7:
                self.block(self.sentence(1, 3, ""), 0, r.choice(["h2", "h3"]))
            for _ in range(r.randint(1, 5)):
                self.html.append(r.choice(['<div class="comment">', "<li>", "<div>", "<article>"]))
                if r.random() < 0.6:
                    self.block(self.sentence(1, 2, ""), 0, r.choice(["h4", "cite", "div"]))
                self.block(self.prose(1, 3), 0)
                self.html.append({"<li>": "</li>", "<article>": "</article>"}.get(self.html[-3 if len(self.html) > 2 else 0], "</div>"))
        else:
            self.html.append(self.sentence(3, 14))
            self.labels.append(0)
        self.html.append(f"</{name.split()[0]}>")

    def article(self) -> None:
        r = self.rnd
        kind = r.choice(["article", "article", "main", "named", "named", "section", "td", "bare"])
        name = {"article": "article", "main": "main", "section": "section", "td": "td", "bare": ""}.get(kind) if kind != "named" else f'div {r.choice(["class", "id"])}="{r.choice(ARTICLE_NAMES)}"'
        if kind == "td":
            self.html.append("<table><tr>")
        if name:
            self.html.append(f"<{name}>")
        if r.random() < 0.8:
            self.block(self.sentence(2, 12, r.choice(["", "."])), 1, "h1")
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.72:
                self.block(self.prose(), 1)
            elif x < 0.8:
                self.block(self.sentence(1, 6, r.choice(["", "."])), 1, r.choice(["p", "h2", "h3"]))
            elif x < 0.85:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.block(self.prose(1, 2), 1, "li")
                self.html.append("</ul>")
            elif x < 0.9:
                self.block(self.prose(1, 3), 1, r.choice(["blockquote", "pre", "figcaption"]))
            elif x < 0.96:
                self.html.append(f"<p>{self.sentence(3, 15)}<br>")
                self.labels.append(1)
                self.block(self.prose(), 1)
            elif r.random() < 0.5:
                self.part(r.choice(["ad", "share", "sidebar"]))
        if name:
            self.html.append(f"</{name.split()[0]}>")
        if kind == "td":
            self.html.append("</tr></table>")


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page and the label of each of its text blocks in order (1: article)."""
    rnd = random.Random(seed)
    page = Page(rnd)
    page.html.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
    for kind, chance in (("notice", 0.25), ("header", 0.4), ("menu", 0.7), ("crumbs", 0.2), ("ad", 0.4)):
        if rnd.random() < chance:
            page.part(kind)
    if rnd.random() < 0.25:
        page.html.append('<div class="wrapper"><div id="container">')
    if rnd.random() < 0.15:
        page.part("sidebar")
    page.article()
    for kind, chance in (("share", 0.25), ("sidebar", 0.3), ("ad", 0.2), ("comments", 0.35), ("form", 0.3), ("notice", 0.15), ("footer", 0.8)):
        if rnd.random() < chance:
            page.part(kind)
    page.html.append("</body></html>")
    return "".join(page.html), page.labels
