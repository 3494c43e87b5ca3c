"""Pages with known main text, to train and to test extraction on.

The given pages carry no labels. So labelled ones are composed here: layouts
in which main text, menus, headers, footers, sidebars, notices, adverts, forms
and comments stand in many kinds of markup. Their number is a parameter, and a
number always gives the same pages.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co de el fi gor hu in ja ka lo men no or pa qui re sa ti un vo wa xe yl zu".split()
CLUTTER = {
    "advert": ("ad ads advert advertisement banner sponsored promo promotion adsense".split(), ["div", "aside", "section", "p"]),
    "menu": ("menu nav navbar navigation breadcrumb topnav links tabs".split(), ["nav", "div", "ul", "section"]),
    "header": ("header masthead top branding logo site-header topbar".split(), ["header", "div"]),
    "footer": ("footer bottom copyright legal site-footer colophon".split(), ["footer", "div"]),
    "sidebar": ("sidebar side widget related recommended trending popular".split(), ["aside", "div", "section"]),
    "notice": ("notice cookie consent alert popup modal newsletter subscribe gdpr message".split(), ["div", "section", "dialog", "aside", "p"]),
    "comments": ("comments comment replies responses discussion disqus thread".split(), ["section", "div", "ol", "article"]),
    "form": ("form login search signup contact feedback".split(), ["form"]),
    "share": ("share social follow tags meta toolbar".split(), ["div", "ul"]),
}
LINES = {
    "advert": ["Advertisement", "Sponsored", "{s}", "{s} {s}", "Advertisement {p}", "{p} Sponsored"],
    "menu": ["{w}", "{w} {w}", "{w}"],
    "header": ["{w} {w}", "{s}", "{w}"],
    "footer": ["© {w}", "© {w}. All rights reserved.", "Privacy Terms {w}", "© {w} · {s}", "{s}", "{s} {s}"],
    "sidebar": ["Related", "{w} {w} {w}", "{s}", "Read more"],
    "notice": ["We use cookies. {s}", "Subscribe to our newsletter", "{s}", "{s} {s}", "{p} Subscribe to our newsletter.", "We use cookies. {p}"],
    "comments": ["Comments", "{w} {w}", "{s}", "{s} {s}", "Reply", "{p} Reply", "{p} Reply to this comment.", "{p} Share"],
    "form": ["E-mail", "Search", "Submit", "{w}", "{s}"],
    "share": ["Share", "Follow {w}", "{w}", "{w}"],
}


class _Page:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)
        self.main: set[str] = set()
        self.used: set[str] = set()

    def word(self) -> str:
        return "".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 4)))

    def sentence(self, least: int = 1, most: int = 14) -> str:
        words = [self.word() for _ in range(self.random.randint(least, most))]
        return " ".join(words).capitalize() + self.random.choice("....!?")

    def paragraph(self, least: int = 2, most: int = 20) -> str:
        """Several sentences, as long as those of an article."""
        return " ".join(self.sentence(4, 14) for _ in range(self.random.randint(least, most)))

    def hinting(self) -> str:
        """An article's paragraph that has a word of clutter somewhere inside."""
        word = self.random.choice(["reply", "comment", "share", "subscribe", "cookie", "follow", "search", "terms", "privacy", "related", "menu"])
        middle = f"{self.word().capitalize()} {self.word()} {word} {self.word()} {self.word()}."
        return f"{self.paragraph(1, 8)} {middle} {self.paragraph(1, 8)}"

    def fresh(self, make) -> str:
        """A text that this page does not have yet, so that it can be told by its words."""
        while (text := make()) in self.used:
            pass
        self.used.add(text)
        return text

    def content(self) -> str:
        make = self.random.choices(
            [
                lambda: " ".join(self.sentence() for _ in range(self.random.randint(2, 8))),
                lambda: self.sentence(),
                lambda: " ".join(f"{self.word()}{self.random.choice(['###', ' |', '$', '!!'])}" for _ in range(self.random.randint(3, 60))),
                lambda: self.paragraph(8, 30),
                lambda: self.hinting(),
            ],
            [8, 4, 1, 1, 1],
        )[0]
        text = self.fresh(make)
        self.main.add(text)
        return text

    def clutter(self, kind: str, plain: float = 0.3) -> str:
        r = self.random
        names, tags = CLUTTER[kind]
        tag = r.choice(tags)
        named = tag in ("div", "p", "ul", "ol", "section", "article") or r.random() > plain
        attribute = f' {r.choice(["class", "id"])}="{r.choice(["", "page-", "js_", "main-"])}{r.choice(names)}"' if named else ""
        inner = []
        for _ in range(1 if tag == "p" else r.randint(1, 6)):
            line = r.choice(LINES[kind])
            text = self.fresh(lambda: line.replace("{w}", self.word().capitalize(), 1).replace("{w}", self.word()).replace("{s}", self.sentence(1, 20), 1).replace("{s}", self.sentence()).replace("{p}", self.paragraph()) + (f" {self.word()}" if "{" not in line else ""))
            linked = kind in ("menu", "sidebar", "share") or r.random() < 0.15
            text = f'<a href="/{self.word()}">{text}</a>' if linked else text
            if tag in ("ul", "ol") or kind == "menu" and r.random() < 0.6:
                inner.append(f"<li>{text}</li>")
            elif kind == "form":
                inner.append(r.choice([f"<label>{text}</label><br><input name=q><br>", f"<p>{text}</p>", f"<button>{text}</button>"]))
            else:
                inner.append(r.choice([f"<p>{text}</p>", f"<div>{text}</div>", f"<span>{text}</span>", f"<h3>{text}</h3>" if kind == "sidebar" else text]))
                if not inner[-1].startswith(("<p>", "<div>", "<h3>")):
                    inner[-1] += "<hr>"
        if tag == "p":
            return f"<p{attribute}>{self.fresh(lambda: self.sentence())}</p>"
        body = "".join(inner)
        if kind == "menu" and "<li>" in body and tag != "ul":
            body = f"<ul>{body}</ul>"
        return f"<{tag}{attribute}>{body}</{tag}>"

    def article(self) -> str:
        r = self.random
        parts = [f"<h1>{self.content()}</h1>"]
        if r.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.randint(0, 12)):
            shape = r.random()
            if shape < 0.62:
                parts.append(f"<p>{self.content()}</p>")
            elif shape < 0.7:
                parts.append(f"<p><b>{self.content()}<br>")  # left open, as on many pages
            elif shape < 0.76:
                parts.append(f"<h2>{self.content()}</h2>")
            elif shape < 0.82:
                parts.append("<ul>" + "".join(f"<li>{self.content()}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif shape < 0.86:
                parts.append(f"<blockquote><p>{self.content()}</p></blockquote>")
            elif shape < 0.89:
                parts.append(f"<figure><img src=x><figcaption>{self.content()}</figcaption></figure>")
            elif shape < 0.91:
                parts.append(f"<table><tr><td>{self.content()}</td><td>{self.content()}</td></tr></table>")
            elif shape < 0.93:
                parts.append(f"<pre>{self.content()}</pre>")
            else:
                parts.append(self.clutter(r.choice(["advert", "notice", "share", "form", "sidebar"])))
        body = "".join(parts)
        name = r.choice(["content", "post", "entry", "article-body", "story", "text"])
        kind = r.random()
        if kind < 0.45:
            return f"<article>{body}</article>"
        if kind < 0.6:
            return f"<main>{body}</main>"
        if kind < 0.75:
            return f"<main><article class='{name}'>{body}</article></main>"
        return f'<div {r.choice(["class", "id"])}="{name}">{body}</div>'

    def source(self) -> str:
        r = self.random
        optional = lambda kind, chance: self.clutter(kind) if r.random() < chance else ""
        before = [optional("header", 0.5), optional("menu", 0.8), optional("notice", 0.35), optional("advert", 0.6), optional("form", 0.2)]
        after = [optional("sidebar", 0.5), optional("share", 0.25), optional("comments", 0.5), optional("advert", 0.3), optional("form", 0.2), optional("footer", 0.85)]
        title = self.fresh(self.sentence)
        end = "</body></html>" if r.random() < 0.9 else ""
        return (
            f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
            f"{''.join(before)}<!-- {self.word()} -->{self.article()}{''.join(after)}{end}"
        )


def labelled_pages(count: int, first: int = 0) -> list[tuple[str, set[str]]]:
    """Return ``count`` pages and the texts of their main blocks."""
    pages = [_Page(first + k) for k in range(count)]
    return [(page.source(), page.main) for page in pages]
