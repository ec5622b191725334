"""Labelled pages to train the extraction model on: made from templates by a seeded generator, so none are stored.

Each page is (html, spans): its markup, in which texts that belong to the article are known by the words drawn for them. Templates
come in families: semantic tags alone, named containers alone, bare containers that only their words and measures tell apart, and
all of these mixed. Menus, headers, notices, adverts, sidebars, forms, comments and footers come and go, also inside the article;
some tags are left open.
"""

from __future__ import annotations

import random

#: Syllables of made-up words.
SYLLABLES = "ba be bi bo bu da de di do du fa fe ga ge go ka ke ko la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se si so ta te ti to va ve vi za ze zo el an er in on us".split()
#: What stands around articles, by part.
CUES = {
    "footer": ["&copy; 2020", "Copyright 2021", "All rights reserved", "Terms of use", "Privacy policy", "Impressum", "Mentions légales", "Alle Rechte vorbehalten", "Tous droits réservés", "Todos los derechos reservados", "Datenschutz"],
    "advert": ["Advertisement", "Sponsored", "Anzeige", "Werbung", "Publicité", "Publicidad", "Ad:"],
    "notice": ["This site uses cookies", "Accept cookies", "Subscribe to our newsletter", "We value your privacy", "Cookies akzeptieren", "Sign up"],
    "sidebar": ["Related articles", "Read more", "Most popular", "Share this", "Follow us", "Recommended"],
    "comments": ["Comments", "Leave a reply", "Reply", "Kommentare", "Commentaires", "Comentarios"],
    "form": ["Search", "Log in", "Sign in", "Subscribe"],
}
FAMILIES = ("semantic", "named", "bare", "mixed")


class Page:
    """Writes one page; words in content texts end in the mark "q", all others do not."""

    def __init__(self, seed: int, families: tuple[str, ...] = FAMILIES):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.family = self.r.choices(families, [5 if f == "mixed" else 1 for f in families])[0]

    def cue(self, part: str) -> str:
        return self.r.choice(CUES[part]) + " " if self.r.random() < (0.95 if self.family == "bare" else 0.35) else ""

    def word(self, mark: bool) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return w + "q" if mark else w

    def words(self, n: int, mark: bool) -> str:
        out = []
        for _ in range(n):
            w = self.word(mark)
            out.append(w + self.r.choice(["", "", "", "", "", ",", ".", "."]))
        return " ".join(out).capitalize()

    def put(self, *parts: str) -> None:
        self.out += parts

    def box(self, tags: list[str], names: list[str], semantic: float = 0.5) -> tuple[str, str]:
        """An opening and a closing tag: a semantic one, or a container with one of the names, or both."""
        r = self.r
        if self.family == "bare":
            return "<div>", "</div>"
        semantic = {"semantic": 1.0, "named": 0.0}.get(self.family, semantic)
        if tags and r.random() < semantic:
            tag = r.choice(tags)
            attr = f' class="{r.choice(names)}"' if names and r.random() < 0.3 else ""
        else:
            tag = r.choice(["div", "div", "div", "section"])
            attr = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", " box", " wide", "-wrap"])}"' if names else ""
        return f"<{tag}{attr}>", f"</{tag}>"

    def inline(self, n: int, mark: bool) -> str:
        text, r = self.words(n, mark), self.r
        if r.random() < 0.3:
            parts = text.split(" ")
            k = r.randrange(len(parts))
            tag = r.choice(["b", "i", "em", "strong", "a href=\"/x\"", "span", "code"])
            parts[k] = f"<{tag}>{parts[k]}" + (f"</{tag.split()[0]}>" if r.random() < 0.85 else "")
            text = " ".join(parts)
        return text + (r.choice(["<br>", "<br/>"]) + self.words(4, mark) if r.random() < 0.1 else "")

    def links(self, n: int, mark: bool = False) -> None:
        kind = self.r.random()
        if kind < 0.7:
            tag = self.r.choice(["ul", "ul", "ol"])
            self.put(f"<{tag}>", *[f'<li><a href="/{self.word(False)}">{self.words(self.r.randint(1, 5), mark)}</a></li>' for _ in range(n)], f"</{tag}>")
        else:
            self.put(*[f'<a href="/{self.word(False)}">{self.words(self.r.randint(1, 3), mark)}</a>{self.r.choice([" ", " | ", ""])}' for _ in range(n)])

    def menu(self) -> None:
        a, b = self.box(["nav"], ["nav", "menu", "navbar", "breadcrumbs", "main-menu", "topnav", "toc"], 0.6)
        self.put(a)
        self.links(self.r.randint(2, 9))
        self.put(b)

    def advert(self) -> None:
        a, b = self.box(["aside"], ["ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot"], 0.05)
        self.put(self.r.choice(["", f"<!-- ad {self.r.randint(1, 999)} -->"]), a, self.r.choice(["", "<p>"]), self.cue("advert"), self.words(self.r.randint(3, 25), False), b)

    def notice(self) -> None:
        r = self.r
        attr = r.choice(['class="notice"', 'class="cookie-banner"', 'id="cookie-consent"', 'role="alert"', 'class="alert"', 'class="newsletter"', 'class="popup modal"', 'class="subscribe"', 'class="gdpr"'])
        attr = "" if self.family == "bare" else " " + attr
        self.put(f"<div{attr}>", f"<p>{self.cue('notice')}{self.words(r.randint(4, 30), False)}</p>", r.choice(["", f"<button>{self.words(1, False)}</button>", f'<a href="/privacy">{self.words(2, False)}</a>']), "</div>")

    def form(self) -> None:
        r = self.r
        self.put(f'<form action="/x"{r.choice(["", " class=search", " id=contact"])}>', *[f"<label>{self.cue('form')}{self.words(2, False)}</label><input name=a>" for _ in range(r.randint(1, 3))], r.choice(["", f"<p>{self.words(9, False)}</p>", f"<select><option>{self.words(2, False)}</option></select>"]), f"<button>{self.words(1, False)}</button></form>")

    def header(self) -> None:
        a, b = self.box(["header"], ["header", "masthead", "site-header", "topbar", "logo"], 0.6)
        self.put(a, self.r.choice([f"<h1>{self.words(3, False)}</h1>", f"<p>{self.words(5, False)}</p>", f'<a href="/">{self.words(2, False)}</a>', f"<div>{self.words(4, False)}</div>"]))
        if self.r.random() < 0.4:
            self.menu()
        if self.r.random() < 0.2:
            self.form()
        self.put(b)

    def footer(self) -> None:
        a, b = self.box(["footer"], ["footer", "site-footer", "copyright", "bottom", "legal"], 0.65)
        self.put(a, self.r.choice(["&copy; ", "", "<p>&copy; "]) if self.family != "bare" else "", self.cue("footer"), self.words(self.r.randint(2, 25), False))
        if self.r.random() < 0.4:
            self.links(self.r.randint(2, 6))
        self.put(b)

    def sidebar(self) -> None:
        a, b = self.box(["aside"], ["sidebar", "side", "widget", "rail", "related", "recommended", "popular", "share", "social", "tags"], 0.5)
        self.put(a, self.r.choice(["", f"<h3>{self.cue('sidebar')}{self.words(2, False)}</h3>", f"<h2>{self.cue('sidebar')}{self.words(2, False)}</h2>"]))
        for _ in range(self.r.randint(1, 3)):
            if self.r.random() < 0.5:
                self.links(self.r.randint(2, 6))
            else:
                self.put(f"<p>{self.cue('sidebar')}{self.words(self.r.randint(4, 40), False)}</p>")
        self.put(b)

    def comments(self) -> None:
        r = self.r
        name = r.choice(["comments", "comment-list", "discussion", "replies", "responses"])
        outer = r.choice(["section", "div", "ol"])
        inner = "li" if outer == "ol" else r.choice(["div", "div", "article"])
        bare = self.family == "bare"
        self.put(f"<{outer}>" if bare else f'<{outer} {r.choice(["class", "id"])}="{name}">', r.choice(["", f"<h3>{self.cue('comments')}{self.words(2, False)}</h3>"]))
        for _ in range(r.randint(1, 5)):
            named = "" if bare else f' class="{r.choice(["comment", "reply", "comment-body", "user-comment"])}"'
            self.put(f"<{inner}{named}>", r.choice(["", f"<b>{self.words(1, False)}</b>"]), f"<p>{self.cue('comments')}{self.words(r.randint(3, 60), False)}</p>", f"</{inner}>")
        if r.random() < 0.3:
            self.form()
        self.put(f"</{outer}>")

    def block(self) -> None:
        r, kind = self.r, self.r.random()
        close = r.random() < 0.9
        if kind < 0.68:
            self.put("<p>", self.inline(r.choice([r.randint(1, 8), r.randint(8, 120)]), True), "</p>" if close else "")
        elif kind < 0.76:
            h = r.choice(["h2", "h3", "h4"])
            self.put(f"<{h}>", self.words(r.randint(1, 9), True), f"</{h}>")
        elif kind < 0.83:
            tag = r.choice(["ul", "ol"])
            self.put(f"<{tag}>", *[f"<li>{self.inline(r.randint(1, 20), True)}{'</li>' if close else ''}" for _ in range(r.randint(1, 6))], f"</{tag}>")
        elif kind < 0.88:
            self.put("<blockquote>", r.choice(["", "<p>"]), self.inline(r.randint(5, 40), True), "</blockquote>")
        elif kind < 0.91:
            self.put("<table>", *["<tr>" + "".join(f"<td>{self.words(r.randint(1, 4), True)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))], "</table>")
        elif kind < 0.94:
            self.put("<pre>", self.words(r.randint(5, 30), True).replace(". ", ".\n"), "</pre>")
        elif kind < 0.97:
            self.put('<figure><img src="/a.png">', f"<figcaption>{self.words(r.randint(2, 12), True)}</figcaption>", "</figure>")
        else:
            self.put("<div>", self.inline(r.randint(4, 60), True), "</div>")

    def content(self) -> None:
        r = self.r
        a, b = self.box(["article", "article", "main"], ["content", "post", "entry", "article-body", "story", "main", "main-content", "post-content", "text", "page-body"], 0.7)
        wrapped = r.random() < 0.3
        if wrapped:
            self.put("<main>" if "main" not in a else "<div>")
        self.put(a)
        if r.random() < 0.8:
            self.put("<h1>", self.words(r.randint(2, 10), True), "</h1>")
        inner = r.random() < 0.25
        if inner:
            self.put(f'<div{r.choice(["", " class=body", " class=entry-content", " class=text"])}>')
        for _ in range(r.choice([1, 2, r.randint(3, 14)])):
            self.block()
            if r.random() < 0.09:
                r.choice([self.advert, self.notice, self.form, self.sidebar, self.header, self.footer, self.menu, self.comments])()
        if inner:
            self.put("</div>")
        if r.random() < 0.08:
            self.comments()
        self.put(b)
        if wrapped:
            self.put("</main>" if "main" not in a else "</div>")

    def html(self) -> str:
        r = self.r
        self.put("<!DOCTYPE html><html><head><title>", self.words(5, False), "</title><script>var x = '<p>" + self.words(3, False) + "</p>';</script></head><body>")
        wrap = r.random() < 0.25
        if wrap:
            self.put(f'<div {r.choice(["id=page", "class=container", "class=wrapper"])}>')
        before = [f for f, p in ((self.notice, 0.25), (self.header, 0.55), (self.menu, 0.6), (self.advert, 0.4), (self.sidebar, 0.25), (self.form, 0.1)) if r.random() < p]
        after = [f for f, p in ((self.comments, 0.35), (self.sidebar, 0.35), (self.advert, 0.25), (self.form, 0.15), (self.notice, 0.1)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        for f in before:
            f()
        self.content()
        for f in after:
            f()
        if r.random() < 0.8:
            self.footer()
        if wrap:
            self.put("</div>")
        self.put(r.choice(["</body></html>", "</body></html>", ""]))
        return "".join(self.out)


def pages(n: int, seed: int = 1, families: tuple[str, ...] = FAMILIES) -> list[str]:
    """n pages whose content words, and no others, end in "q"."""
    return [Page(seed * 100_003 + k, families).html() for k in range(n)]


def is_content(text: str) -> bool:
    """Whether a text of such a page belongs to the article."""
    found = [w.strip(".,").lower() for w in text.split()]
    found = [w for w in found if w.isalpha()]
    return bool(found) and sum(w.endswith("q") for w in found) * 2 > len(found)
