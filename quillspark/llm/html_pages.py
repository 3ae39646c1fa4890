"""Labelled web pages for training: made from a seed, so each block's label is known."""

from __future__ import annotations

import html
import random

from .html_blocks import leaf_blocks

_SYLLABLES = "ra ne to li ka mu se vo pi du an er or est ing que lo den bra shi tan mer ou ch ä é ción ß zu ha".split()
#: Scripts of pages other than Latin ones: first and last letter, and whether words are set apart by spaces.
SCRIPTS = [("а", "я", True), ("α", "ω", True), ("ا", "ي", True), ("가", "깋", True), ("あ", "ん", False), ("一", "龥", False), ("ก", "ฮ", False)]
#: How often a page is of one of SCRIPTS.
OTHER_SCRIPTS = 0.25
# Names that pages give their parts.
MENU = "nav menu navbar navigation topbar breadcrumb breadcrumbs toc pagination pager tabs".split()
SIDE = "sidebar side rail related widget trending popular recommended recommendations more".split()
ADVERT = "ad ads adslot adbox adunit adzone advert advertisement sponsor sponsored promo banner promotion".split()
NOTICE = "cookie cookies consent notice alert gdpr popup modal overlay privacy message".split()
COMMENT = "comments comment discussion replies reply respond responses disqus feedback reviews".split()
FORM = "newsletter subscribe signup login search contact subscription".split()
SHARE = "share social sharing follow buttons tools".split()
FOOT = "footer foot copyright legal bottom colophon".split()
HEAD = "header masthead branding top logo site".split()
ENDS = ["", "", "", "-box", "-inner", "-wrap", "-1", "_main", "list", "nav", "item", "area", "zone", "holder", "section", "block"]
NEUTRAL = "wrapper container inner row col columns grid block section box module left right".split()
BODY = "article post entry content story body text main page news blog detail single".split()
LINE = "byline author meta date dateline lead intro summary standfirst caption".split()


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.parts: list[str] = []
        self.marks: list[str] = []  # the texts of content blocks, as leaf_blocks gives them
        self.letters, self.spaced = _SYLLABLES, True
        if rng.random() < OTHER_SCRIPTS:
            first, last, self.spaced = rng.choice(SCRIPTS)
            self.letters = [chr(c) for c in range(ord(first), ord(last) + 1)]

    def words(self, low: int, high: int) -> str:
        """Made-up words; a script without spaces has signs between some of them instead."""
        r = self.rng
        out = ["".join(r.choices(self.letters, k=r.choice([1, 1, 2, 2, 3, 4]))) for _ in range(r.randint(low, high))]
        return " ".join(out) if self.spaced else "".join(w + "、" if r.random() < 0.1 else w for w in out[:-1]) + out[-1]

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.rng.choice([".", ".", ".", ".", "!", "?"] if self.spaced else ["。", "。", "。", "！", "？"])

    def paragraph(self) -> str:
        """Sentences, or now and then a few words alone."""
        r = self.rng
        if r.random() < 0.06:
            return self.sentence(1, 4)
        return (" " if self.spaced else "").join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13])))

    def attributes(self, names: list[str]) -> str:
        r, name = self.rng, self.rng.choice(names)
        if r.random() < 0.15:
            return ""
        name += r.choice(ENDS)
        return r.choice([f' class="{name}"', f" class='{name}'", f' id="{name}"', f' class="c-{name} x"'])

    def add(self, markup: str) -> None:
        self.parts.append(markup)

    def any_name(self) -> str:
        """Attributes that say nothing, or nothing known."""
        r = self.rng
        kind = r.random()
        return "" if kind < 0.4 else f' class="{r.choice(NEUTRAL)}"' if kind < 0.6 else f' {r.choice(["class", "id"])}="{self.words(1, 1)}"'

    def content(self, tag: str, text: str, names: str | None = None) -> None:
        r = self.rng
        shown = html.escape(text, quote=False)
        if r.random() < 0.15:
            shown = shown.replace("ä", "&auml;").replace("é", "&#233;")
        if " " in shown and r.random() < 0.3:
            a, b = shown.split(" ", 1)
            shown = r.choice([f"<b>{a}</b> {b}", f"<a href='/{self.words(1, 1)}'>{a}</a> {b}", f"{a}\n  <em>{b}</em>", f"{a}<br>{b}", f"<b>{a} {b}"])
        closed = r.random() < 0.85 or tag not in ("p", "li")
        at = names if names is not None else self.any_name() if r.random() < 0.15 else ""
        self.add(f"<{tag}{at}>{shown}" + (f"</{tag}>" if closed else "") + r.choice(["", "\n"]))
        self.marks.append(text)

    def links(self) -> str:
        r = self.rng
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 8))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return r.choice([" | ", " "]).join(items)

    def box(self, names: list[str], tags: list[str], inner: str) -> None:
        tag = self.rng.choice(tags)
        if inner.count("<a ") > 1 and self.rng.random() < 0.25:  # links tell by themselves, so names may be of any kind
            names = [self.words(1, 1)]
        # a plain element must say by its name what it is
        at = self.attributes(names) if tag not in ("div", "section", "p") else f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}{self.rng.choice(ENDS)}"'
        self.add(f"<{tag}{at}>{inner}</{tag}>")

    def comments(self) -> None:
        r = self.rng
        inner = f"<h3>{self.words(1, 3)}</h3>"
        for _ in range(r.randint(1, 4)):
            who = r.choice(["", f"<span class='author'>{self.words(1, 2)}</span>", f"<h4>{self.words(1, 2)}</h4>"])
            inner += r.choice([f"<div class='comment'>{who}<p>{self.paragraph()}</p></div>", f"<li>{who}<p>{self.paragraph()}</p></li>", f"<p>{self.paragraph()}</p>", f"<li><article class='comment-body'>{who}<p>{self.paragraph()}</p></article></li>"])
        self.box(COMMENT, ["div", "section", "div", "aside"], inner)

    def advert(self) -> None:
        self.box(ADVERT, ["div", "div", "aside", "section", "p"], self.rng.choice([self.sentence(), f"<p>{self.paragraph()}</p>", f"<a href='/x'>{self.sentence()}</a>"]))

    def notice(self) -> None:
        self.box(NOTICE, ["div", "section", "aside"], f"<p>{self.sentence()}</p><button>{self.words(1, 2)}</button>" if self.rng.random() < 0.7 else self.sentence())

    def form(self) -> None:
        inner = f"<label>{self.words(1, 3)}</label><input type='text'><select><option>{self.words(1, 1)}</option><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>"
        if self.rng.random() < 0.5:
            inner = f"<p>{self.sentence()}</p>" + inner
        self.add(f"<form{self.attributes(FORM)}>{inner}</form>")

    def sign_up(self) -> None:
        """A box that asks for an address, with or without a form element."""
        r = self.rng
        inner = r.choice(["", f"<h3>{self.words(2, 6)}</h3>", f"<h4>{self.words(1, 4)}</h4>"]) + f"<p>{self.sentence()}</p>"
        field = f"<input type='email'><button>{self.words(1, 2)}</button>"
        inner += r.choice([field, f"<form>{field}</form>", f"<form><label>{self.words(1, 2)}</label>{field}</form>", ""])
        self.box(FORM, ["div", "div", "section", "aside"], inner)

    def lines(self) -> None:
        """By-line, date and lead: parts of the article."""
        r = self.rng
        for _ in range(r.choice([1, 1, 2])):
            tag = r.choice(["p", "div", "p", "address"])
            self.content(tag, r.choice([self.words(2, 4).title(), self.words(3, 7).capitalize(), self.sentence()]), f' class="{r.choice(LINE)}"' if r.random() < 0.7 else "")

    def side(self) -> None:
        self.box(SIDE, ["aside", "aside", "div", "section"], self.rng.choice([f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.paragraph()}</p>", f"<h4>{self.sentence()}</h4><p>{self.sentence()}</p>"]))

    def plain(self) -> None:
        """Text that stands in no paragraph, its lines ended by br: one block."""
        lines = [self.sentence() for _ in range(self.rng.randint(1, 6))]
        self.add(f"<div{self.any_name()}>" + self.rng.choice(["<br>", "<br><br>\n", "<br/>"]).join(lines) + "</div>")
        self.marks.append(" ".join(lines))

    def article(self) -> None:
        r = self.rng
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", ""])
        if tag in ("div", "section"):
            names = f' class="{r.choice(BODY)}{r.choice(["", "", "-body", "-content", "_text", "-1"])}"' if r.random() < 0.6 else self.any_name()
        else:
            names = self.attributes(BODY)
        if tag:
            self.add(f"<{tag}{names}>")
        wrapped = r.random() < 0.2
        if r.random() < 0.85:
            if wrapped:
                self.add("<header>")
            self.content(r.choice(["h1", "h1", "h2"]), self.words(1, 12).capitalize() + r.choice(["", "."]))
            if wrapped:
                self.add("</header>")
        if r.random() < 0.3:
            self.lines()
        if r.random() < 0.2:
            self.box(SHARE, ["div", "ul"], self.links())
        inside = r.random() < 0.3
        if inside:
            self.add(f'<div class="{r.choice(NEUTRAL + BODY)}">' if r.random() < 0.8 else "<div>")
        plain = r.random() < 0.06
        if plain:
            self.plain()
        many = 0 if plain else r.choice([1, 2, 3, 4, 6, 9])
        broken = r.randrange(many) if many and r.random() < 0.3 else -1  # where a box stands for sure
        for i in range(many):
            if i == broken:
                r.choice([self.sign_up, self.sign_up, self.advert])()
            kind = r.random()
            if kind < 0.62:
                self.content("p", self.paragraph())
            elif kind < 0.7:
                self.content(r.choice(["h2", "h3", "h4"]), self.words(1, 6).capitalize())
            elif kind < 0.76:
                listed = r.choice(["ul", "ol"])
                self.add(f"<{listed}>")
                for _ in range(r.randint(1, 4)):
                    self.content("li", self.sentence(1, 10))
                self.add(f"</{listed}>")
            elif kind < 0.8:
                self.add("<blockquote>")
                self.content("p", self.paragraph())
                self.add("</blockquote>")
            elif kind < 0.82:
                self.add("<table><tr>")
                self.content("td", self.words(1, 4))
                self.content("td", self.words(1, 4))
                self.add("</tr></table>")
            elif kind < 0.835:
                self.add("<figure><img src='x.png'>")
                self.content("figcaption", self.sentence())
                self.add("</figure>")
            elif kind < 0.845:
                self.content("pre", self.words(2, 12))
            else:
                r.choice([self.advert, self.advert, self.side, self.form, self.sign_up, self.sign_up, self.notice, self.comments])()
        if inside:
            self.add("</div>")
        if r.random() < 0.25:
            self.comments()
        if tag:
            self.add(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        self.add(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body{r.choice(['', self.attributes(BODY)])}>")
        if r.random() < 0.15:  # an article and nothing else
            if r.random() < 0.25:  # of a few words
                tag = r.choice(["article", "main", "div"])
                self.add(f"<{tag}{self.any_name()}>")
                self.content("p", self.sentence(1, 5))
                self.add(f"</{tag}>")
            else:
                self.article()
            return self.finished()
        if r.random() < 0.35:
            self.notice()
        if r.random() < 0.5:
            self.box(HEAD, ["header", "header", "div"], r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.sentence()}</p>", ""]) + self.links())
        if r.random() < 0.8:
            self.box(MENU, ["nav", "nav", "div"], self.links())
        if r.random() < 0.5:
            self.advert()
        if r.random() < 0.25:
            self.form()
        outer = r.random() < 0.4
        if outer:
            self.add(r.choice(["<div class='wrapper'>", "<div id='page'>", "<div class='container'><div class='row'>", "<main>", "<main id='main'>"]))
        if r.random() < 0.3:
            self.side()
        if r.random() < 0.96:
            self.article()
        for make, chance in ((self.comments, 0.3), (self.side, 0.35), (self.advert, 0.3), (self.form, 0.2), (self.sign_up, 0.15)):
            if r.random() < chance:
                make()
        if outer:
            self.add("</div>")
        if r.random() < 0.8:
            self.box(FOOT, ["footer", "footer", "div"], r.choice(["&copy; ", "", "Copyright "]) + r.choice([self.sentence(), f"{self.words(1, 2)} &middot; {self.sentence()}", self.links(), f"<p>{self.paragraph()}</p>"]))
        return self.finished()

    def finished(self) -> tuple[str, list[int]]:
        self.add(self.rng.choice(["</body></html>", "", "</html>"]))
        page = "".join(self.parts)
        wanted, labels = list(self.marks), []
        for text, *_ in leaf_blocks(page):
            is_content = bool(wanted) and text == " ".join(wanted[0].split())
            if is_content:
                wanted.pop(0)
            labels.append(int(is_content))
        if wanted:
            raise AssertionError(f"a content block was not found: {wanted[0]!r}")
        return page, labels


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """n pages, each with a label for each of its leaf blocks."""
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]
