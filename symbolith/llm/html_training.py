"""Labelled web pages to train on: invented pages of many layouts whose blocks are known to be main text or not.

The words are invented, so that nothing but a few words of page furniture can be learned from text itself; layouts,
class names and lengths are drawn from lists of what sites commonly use.
"""

from __future__ import annotations

import random

_BITS = "ka lo mi ren tas ul ver no shi pel or and ing est ba du fe gri ho ju".split()
_ARTICLE = ["content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text", "page-content", "body-text", ""]
_SIDE = ["sidebar", "widget", "related", "rail", "secondary", "popular", "recommended", "side-column"]
_AD = ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad-slot", "adbox"]
_NOTICE = ["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "gdpr", "newsletter", "subscribe", "message"]
_COMMENT = ["comments", "comment", "comment-list", "replies", "discussion", "responses", "reader-comments", "disqus"]
_MENU = ["nav", "menu", "navbar", "navigation", "breadcrumb", "toc", "pagination", "tags", "share", "social"]
_HEAD = ["header", "site-header", "masthead", "topbar", "logo", "branding"]
_FOOT = ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"]
_NOISE = ["row", "wrap", "container", "inner", "col", "box", "x1", "block", "grid", ""]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_BITS) for _ in range(self.r.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return " ".join(self.word() for _ in range(n)).capitalize()

    def prose(self, low: int, high: int) -> str:
        out = [self.words(3, 16) + self.r.choice("...!?") for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.3:
            out.insert(self.r.randrange(len(out) + 1), f'<a href="/{self.word()}">{self.words(1, 4)}</a>')
        if self.r.random() < 0.2:
            out.insert(0, f"<b>{self.words(1, 3)}</b>")
        if self.r.random() < 0.1:
            sign = self.r.choice(["&amp;", "&quot;", "&#8212;", "&nbsp;", "*", "#", "|", "~", "/"])
            out.append(f"{sign} {self.words(1, 2)} {sign * self.r.randint(0, 3)}".strip())
        return " ".join(out)

    def box(self, tags: list[str], classes: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        name = self.r.choice(classes)
        more = self.r.choice(_NOISE)
        how = self.r.random()
        if tag in ("nav", "header", "footer", "aside", "form") and how < 0.5 or not name + more:
            attribute = ""
        elif how < 0.75:
            attribute = f' class="{(name + " " + more).strip()}"'
        else:
            attribute = f' id="{name or more}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        how = self.r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if how < 0.8 else " ").join(items)

    def article(self) -> tuple[str, list[tuple[str, int]]]:
        """The page's main part: {} inside its own mark-up, and the pieces that belong there with their labels."""
        r, out = self.r, []
        if r.random() < 0.8:
            out.append((f"<h1>{self.words(2, 9)}</h1>", 1))
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            how = r.random()
            if how < 0.72:
                piece = f"<p>{self.prose(1, r.choice([1, 2, 4, 8]))}" + "</p>" * (r.random() < 0.9)
            elif how < 0.8:
                piece = f"<h{r.randint(2, 4)}>{self.words(1, 7)}</h2>"
            elif how < 0.86:
                piece = "<ul>" + "".join(f"<li>{self.prose(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif how < 0.9:
                piece = f"<blockquote>{self.prose(1, 3)}</blockquote>"
            elif how < 0.93:
                piece = f"<pre>{self.words(2, 12)}</pre>"
            elif how < 0.96:
                piece = "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
            else:
                piece = f"<p>{self.words(1, 2)}.</p>"
            out.append((piece, 1))
            if r.random() < 0.12:
                out.append((self.extra(), 0))
        return self.box(r.choice([["article"], ["article"], ["main"], ["div"], ["div", "section"]]), _ARTICLE, "{}"), out

    def before(self) -> list[str]:
        r, out = self.r, []
        if r.random() < 0.5:
            name = self.words(1, 4)
            out.append(self.box(["header", "div"], _HEAD, r.choice([name, f"<h1>{name}</h1>", f"<p>{name}.</p>"]) + self.links(0, 4)))
        if r.random() < 0.85:
            out.append(self.box(["nav", "nav", "div"], _MENU, self.links(2, 8)))
        for _ in range(r.choice([0, 0, 1, 2])):
            out.append(self.extra())
        return out

    def extra(self) -> str:
        r = self.r
        return r.choice([
            lambda: self.box(["div", "aside", "section"], _AD, self.prose(1, 3)),
            lambda: self.box(["div", "section"], _NOTICE, self.prose(1, 3) + r.choice(["", "<button>Ok</button>"])),
            lambda: self.box(["form"], ["search", "login", "signup", ""], f"<label>{self.words(1, 4)}</label><input>{r.choice(['', '<p>' + self.prose(1, 1) + '</p>'])}<button>{self.word()}</button>"),
            lambda: self.box(["aside", "div"], _SIDE, f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(2, 6), f"<p>{self.prose(1, 3)}</p>"])),
        ])()

    def after(self) -> list[str]:
        r = self.r
        out = [self.extra() for _ in range(r.choice([0, 1, 1, 2]))]
        if r.random() < 0.4:
            said = "".join(f'<{t}{r.choice(["", " class=comment", " class=reply"])}><p>{self.prose(1, 3)}</p></{t}>' for t in r.choices(["div", "li", "article"], k=r.randint(1, 4)))
            out.append(self.box(["section", "div"], _COMMENT, f"<h3>{self.words(1, 2)}</h3>" + said))
        r.shuffle(out)
        if r.random() < 0.9:
            out.append(self.box(["footer", "footer", "div"], _FOOT, f"&copy; {self.words(1, 3)} &middot; {self.words(2, 9)}. " + self.links(0, 3)))
        return out

    def page(self) -> tuple[str, list[int]]:
        """A page, and of each of its blocks 1 for main text, 0 for anything else."""
        from .html_blocks import blocks

        r = self.r
        frame, main = self.article()
        before, after = self.before(), self.after()
        if r.random() < 0.15:  # a page of nothing but its main part, or with one side only
            before, after = r.choice([([], []), ([], after), (before, [])])
        label = [y for x, y in [*((x, 0) for x in before), *main, *((x, 0) for x in after)] for _ in blocks(x)]
        inner = "\n".join([*before, frame.replace("{}", "\n".join(x for x, _ in main)), *after])
        if r.random() < 0.5:
            inner = f'<div class="{r.choice(_NOISE)}">{inner}</div>'
        extra = [f"<style>{self.word()}{{color:red}} .{self.word()}>p{{width:{r.randint(1, 99)}%}}</style>", f'<script src="/{self.word()}.js"></script>', f"<script>if (a < b) document.write('<p>{self.word()}<\\/p>')</script>"]
        extra += [f'<link rel=stylesheet href="{self.word()}.css">', f'<meta name=description content="{self.words(3, 9)}">', f"<!-- {self.words(1, 5)} -->", f"<noscript><p>{self.words(3, 6)}</p></noscript>"]
        head = f"<head><meta charset=utf-8><title>{self.words(2, 6)}</title>{''.join(r.sample(extra, r.randint(0, 4)))}</head>"
        return f"<!DOCTYPE html><html>{head}<body>{inner}" + "</body></html>" * (r.random() < 0.9), label


def pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
