"""Labelled pages to train the block tagger on: a seeded generator of varied page layouts.

Each page is HTML with markers: main text is written as ordinary markup, and the returned
labels say for each leaf block, in order, whether it is main text. Words are random syllables,
so that the tagger learns from structure and shape, not from a language.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tas vor el an di shu pe qua ti on er ing la de mo ra sen bil cho wu zen fa go hi jo".split()
SITE_WORDS = "Home About Contact News Sport Login Search Archive Privacy Terms Help Shop Topics Jobs".split()

MAIN_WRAPPERS = [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<main id="main"><article class="post">', "</article></main>"),
    ('<div id="content">', "</div>"), ('<div class="post-content entry">', "</div>"), ('<div class="article-body">', "</div>"),
    ('<section class="story">', "</section>"), ('<div class="page"><div class="main text">', "</div></div>"), ("<div><div>", "</div></div>"),
    ("<table><tr><td>", "</td></tr></table>"), ("", ""),
]


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.15:
            words[self.r.randrange(len(words))] += self.r.choice([" &amp;", "###", "***", " &mdash;", "%%%"])
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def put(self, markup: str, *labels: int) -> None:
        self.parts.append(markup)
        self.labels += labels

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.word()}">{text or self.r.choice([self.word().capitalize(), self.r.choice(SITE_WORDS)])}</a>'

    # Boilerplate ------------------------------------------------------------------------

    def links(self, n: int) -> None:
        open_, close = self.r.choice([("<nav><ul>", "</ul></nav>"), ('<ul class="menu">', "</ul>"), ('<div class="nav"><ul>', "</ul></div>"), ('<div id="navigation"><ul>', "</ul></div>"), ("<ul>", "</ul>")])
        end = self.r.choice(["</li>", "</li>", ""])
        self.put(open_ + "".join(f"<li>{self.link()}{end}" for _ in range(n)) + close, *[0] * n)

    def header(self) -> None:
        kind = self.r.randrange(3)
        if kind == 0:
            self.put(f"<header><h1>{self.link(self.sentence(1, 3))}</h1><p>{self.sentence(2, 7)}</p></header>", 0, 0)
        elif kind == 1:
            self.put(f'<div class="header" id="top"><div class="logo">{self.word()}</div></div>', 0)
        else:
            self.put(f"<header>{self.word()} {self.word()}</header>", 0)

    def advert(self) -> None:
        name = self.r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "advertisement"])
        tag = self.r.choice(["div", "div", "aside", "section"])
        body = self.prose(1, 3)
        if self.r.random() < 0.4:
            self.put(f'<{tag} class="{name}"><p>{body}</p><p>{self.link(self.sentence(1, 4))}</p></{tag}>', 0, 0)
        else:
            self.put(f'<{tag} class="{name}">{body}</{tag}>', 0)

    def notice(self) -> None:
        name = self.r.choice(["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "cookie banner", "legal"])
        tag, inner = self.r.choice(["div", "div", "section", "aside"]), self.r.randint(1, 3)
        body = "".join(f"<p>{self.prose(1, 3)}</p>" for _ in range(inner)) if self.r.random() < 0.7 else self.prose(1, 3)
        button = self.r.random() < 0.5
        count = body.count("<p>") or 1
        self.put(f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">{body}{f"<button>{self.word()}</button>" if button else ""}</{tag}>', *[0] * (count + button))

    def promo(self) -> None:
        """Newsletter boxes, related stories, author boxes, tags, breadcrumbs."""
        name = self.r.choice(["newsletter", "subscribe", "related", "promo", "byline", "tags", "breadcrumb", "meta", "widget", "toolbar", "pagination"])
        kind = self.r.randrange(3)
        if kind == 0:
            self.put(f'<div class="{name}"><h3>{self.sentence(1, 5)}</h3><p>{self.prose(1, 2)}</p></div>', 0, 0)
        elif kind == 1:
            n = self.r.randint(1, 4)
            self.put(f'<div class="{name}">' + "".join(f"<p>{self.link(self.sentence(2, 7))}</p>" for _ in range(n)) + "</div>", *[0] * n)
        else:
            self.put(f'<div class="{name}">{self.sentence(1, 8)}</div>', 0)

    def form(self) -> None:
        self.put(f'<form action="/s"><label>{self.word()}</label> <input name=q><p>{self.sentence(2, 9)}</p><button>{self.word()}</button></form>', 0, 0, 0)

    def sidebar(self) -> None:
        open_, close = self.r.choice([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar" class="widget">', "</div>"), ('<aside class="related">', "</aside>")])
        n, m = self.r.randint(1, 3), self.r.randint(0, 4)
        self.put(f"{open_}<h3>{self.sentence(1, 4)}</h3>" + "".join(f"<p>{self.prose(1, 3)}</p>" for _ in range(n)) + ("<ul>" + "".join(f"<li>{self.link(self.sentence(3, 8))}</li>" for _ in range(m)) + "</ul>" if m else "") + close, 0, *[0] * (n + m))

    def comments(self) -> None:
        open_, close = self.r.choice([('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"), ('<ol class="comment-list">', "</ol>"), ('<div class="replies discussion">', "</div>"), ("<div id=disqus_thread class=comments-area>", "</div>")])
        n = self.r.randint(1, 5)
        out, labels = open_, []
        if self.r.random() < 0.6:
            out, labels = out + f"<h2>{self.word()}</h2>", [0]
        for _ in range(n):
            author = self.r.random() < 0.6
            out += f'<div class="{self.r.choice(["comment", "comment", "reply", "comment-body"])}">' + (f'<span class="author">{self.word()}</span>' if author else "") + f"<p>{self.prose(1, 4)}</p></div>"
            labels += [0] * (1 + author)
        self.put(out + close, *labels)

    def share(self) -> None:
        n = self.r.randint(2, 4)
        self.put('<div class="share social">' + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</div>", *[0] * n)

    def footer(self) -> None:
        kind = self.r.randrange(3)
        text = f"&copy; {self.word()}.example.com &middot; {self.sentence(3, 9)}"
        if kind == 0:
            self.put(f"<footer>{text}</footer>", 0)
        elif kind == 1:
            self.put(f"<footer><p>{text}</p><p>{self.link()} {self.link()}</p></footer>", 0, 0)
        else:
            self.put(f'<div class="footer" id="bottom">{text}</div>', 0)

    # Main text --------------------------------------------------------------------------

    def paragraph(self) -> None:
        kind = self.r.random()
        if kind < 0.62:
            text = self.prose() if self.r.random() < 0.94 else self.prose(15, 45)
            if self.r.random() < 0.2:
                text += " " + self.link(self.sentence(1, 4)) + " " + self.sentence()
            self.put(f"<p>{text}</p>", 1)
        elif kind < 0.72:
            self.put(f"<p><b>{self.prose(1, 2)}<br><p>{self.prose()}</p>", 1, 1)
        elif kind < 0.78:
            self.put(f"<p>{self.sentence(1, 3)}</p>", 1)
        elif kind < 0.85:
            self.put(f"<h{(k := self.r.randint(2, 4))}>{self.sentence(1, 6)}</h{k}><p>{self.prose()}</p>", 1, 1)
        elif kind < 0.91:
            n = self.r.randint(2, 5)
            self.put("<ul>" + "".join(f"<li>{self.sentence(3, 14)}</li>" for _ in range(n)) + "</ul>", *[1] * n)
        elif kind < 0.95:
            self.put(f"<blockquote><p>{self.prose()}</p></blockquote>", 1)
        elif kind < 0.98:
            self.put(f"<pre>{self.prose()}</pre>", 1)
        else:
            self.put(f"<div>{self.prose()}</div>", 1)

    def main(self) -> None:
        open_, close = self.r.choice(MAIN_WRAPPERS + MAIN_WRAPPERS[:4])
        self.parts.append(open_)
        kind = self.r.random()
        if kind < 0.62:
            self.put(f"<h1>{self.sentence(2, 9)}</h1>", 1)
        elif kind < 0.72:
            self.put(f"<h2>{self.sentence(2, 9).rstrip('.')}</h2>", 1)
        elif kind < 0.82 and open_.startswith(("<article", "<main")):
            byline = self.r.random() < 0.3
            self.put(f"<header><h1>{self.sentence(2, 9)}</h1>" + (f'<div class="byline">{self.sentence(2, 4)}</div>' if byline else "") + "</header>", 1, *[0] * byline)
        for _ in range(self.r.choice([1, 2, self.r.randint(1, 14), self.r.randint(1, 14)])):
            self.paragraph()
            if self.r.random() < 0.08:
                self.r.choice([self.advert, self.advert, self.share, self.form])()
        if self.r.random() < 0.15:
            self.r.choice([self.share, self.comments, self.form])()
        self.parts.append(close)

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.parts.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.sentence()}</title><script>var a='</p>';</script></head><body>")
        bare = r.random() < 0.2  # nothing before the main text
        for make, share in ((self.notice, 0.4), (self.header, 0.45), (lambda: self.links(r.randint(2, 8)), 0.8), (self.advert, 0.45), (self.form, 0.15), (self.sidebar, 0.15), (self.promo, 0.25)):
            if not bare and r.random() < share:
                make()
        if bare or r.random() < 0.97:
            self.main()
        for make, share in ((self.comments, 0.35), (self.sidebar, 0.3), (self.advert, 0.25), (self.share, 0.2), (self.form, 0.15), (lambda: self.links(r.randint(2, 6)), 0.25), (self.promo, 0.35), (self.footer, 0.8), (self.notice, 0.25)):
            if r.random() < share:
                make()
        self.parts.append("</body></html>")
        return "".join(self.parts), self.labels


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    return [PageMaker(seed * 1_000_003 + k).page() for k in range(n)]
