"""Generated web pages with known main text, on which the extraction model is trained.

Words are random syllables, so that the model can only learn from structure.  Pages vary in
whether they use sectioning elements or classes, in which furniture surrounds the article or stands
inside it, in nesting, in lengths, and in closing their tags.  Names of boxes are joined with words
that say nothing, and some pages name their boxes by syllables alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "ba ko ri tem lu sa den mo vi fa gre pol ny esh tar ul in ok wé ß ño".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, []
        self.plain = rng.random() < 0.4  # hardly anything but some paragraphs
        self.nameless = rng.random() < (0.5 if self.plain else 0.2)  # a page whose names tell nothing
        self.lengths = (1, 2) if self.plain and rng.random() < 0.15 else (1, 4) if rng.random() < 0.15 else (4, 18)  # words of a sentence

    def words(self, n: int) -> str:
        r = self.rng
        one = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) + (str(r.randint(0, 2030)) if r.random() < 0.01 else "")
        return " ".join(str(r.randint(0, 2030)) if r.random() < 0.02 else one() for _ in range(n))

    def sentence(self) -> str:
        text = self.words(self.rng.randint(*self.lengths)).capitalize()
        return text + self.rng.choice([".", ".", ".", "?", "!", ",", " &amp;", "%%%", "!!"])

    def prose(self, least: int = 1, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(least, most)))

    def keep(self, text: str) -> str:
        """Note a block of main text, as it is after decoding."""
        import html

        self.main.append(" ".join(html.unescape(text).split()))
        return text

    def attribute(self, words: str) -> str:
        r = self.rng
        if self.nameless:
            return f' class="{"".join(r.choice(_SYLLABLES) for _ in range(3))}"'
        word = r.choice(words.split())
        extra = r.choice(["", "", "", "-wrap", "_box", " block", " col-3", "Area", "-content", "-text", "-inner", " item"])
        return f' {r.choice(["class", "class", "id"])}="{word}{extra}"'

    def box(self, tags: str, names: str, body: str) -> str:
        """``body`` in an element that speaks by its tag or by an attribute, or by both."""
        r = self.rng
        semantic = tags.split()
        if semantic and r.random() < 0.6:
            return (lambda t: f"<{t}{self.attribute(names) if r.random() < 0.4 else ''}>{body}</{t}>")(r.choice(semantic))
        tag = r.choice(["div", "div", "section"])
        return f"<{tag}{self.attribute(names)}>{body}</{tag}>"

    def links(self, least: int = 2, most: int = 9) -> str:
        r = self.rng
        items = [f'<a href="/{k}">{self.words(r.randint(1, 4))}</a>' for k in range(r.randint(least, most))]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{i}" + ("</li>" if r.random() < 0.8 else "") for i in items) + "</ul>"
        return " | ".join(items) if style < 0.8 else "".join(f"<div>{i}</div>" for i in items)

    def menu(self) -> str:
        return self.box("nav", "nav menu navbar breadcrumb pagination tabs main-menu", self.links())

    def head(self) -> str:
        body = f"<div>{self.words(2)}</div>" if self.rng.random() < 0.5 else f"<p>{self.words(self.rng.randint(2, 8))}</p>"
        return self.box("header", "header masthead topbar site-header logo", body + (self.menu() if self.rng.random() < 0.5 else ""))

    def foot(self) -> str:
        r = self.rng
        legal = r.choice(["&copy; ", "", "&#169; 2020 "]) + self.words(r.randint(1, 3)) + r.choice([" &middot; ", ". "]) + (self.sentence() if r.random() < 0.7 else self.prose(1, 4))
        body = legal if r.random() < 0.5 else f"<p>{legal}</p>"
        return self.box("footer footer footer", "footer site-footer bottom copyright legal", body + (self.links() if r.random() < 0.4 else ""))

    def advert(self) -> str:
        r = self.rng
        x = r.random()
        body = self.words(r.randint(1, 6)) + r.choice(["", ".", "!"]) if x < 0.2 else self.prose(1, 2) if x < 0.6 else f"<p>{self.prose(1, 4)}</p><a href=x>{self.words(2)}</a>" if x < 0.85 else f"<p>{self.prose(1, 2)}</p><p>{self.prose(1, 2)}</p>"
        return self.box("", "ad ad ad ads ads advert adverts sponsored promo banner ad-slot ad-unit advertisement", body)

    def side(self) -> str:
        r = self.rng
        body = f"<h3>{self.words(2)}</h3>" * (r.random() < 0.7) + (self.links() if r.random() < 0.5 else "".join(f"<p>{self.prose(1, 5)}</p>" for _ in range(r.choice([1, 1, 2, 3]))))
        return self.box("aside", "sidebar side widget related rail popular recommended", body)

    def notice(self) -> str:
        return self.box("dialog", "cookie consent notice gdpr alert popup newsletter subscribe", f"<p>{self.prose(1, 3)}</p>" + ("<button>ok</button>" if self.rng.random() < 0.5 else f"<a href=#>{self.words(1)}</a>"))

    def form(self) -> str:
        r = self.rng
        return self.box("form form", "search login signup contact form", r.choice(["<label>{}</label>", "<p>{}</p>", "<p>{}</p>", "<h3>{}</h3>", "{}"]).format(self.words(2)) + "<input name=q>" + (f"<p>{self.sentence()}</p>" if r.random() < 0.5 else "") + "<button>go</button>")

    def unseen(self) -> str:
        """Text that is there but not shown."""
        r = self.rng
        how = r.choice(["hidden", 'style="display:none"', "style='color:red; display: none'"])
        return r.choice(["<p {}>{}</p>", "<div {}>{}</div>", "<div {}><p>{}</p></div>", "<section {}><h2>x</h2><p>{}</p></section>"]).format(how, self.prose(1, 8))

    def share(self) -> str:
        return self.box("", "share social follow sharing", self.links(2, 4))

    def comments(self) -> str:
        r = self.rng
        count = r.randint(1, 6)
        x = r.random()
        who = (lambda: f"<b>{self.words(1)}</b>{r.choice([' ', ': ', '<br>'])}") if x < 0.5 else (lambda: f"<strong>{self.words(2)}</strong> ") if x < 0.7 else (lambda: f"<a href=u>{self.words(1)}</a> {r.randint(1, 28)}.{r.randint(1, 12)}. ") if x < 0.85 else (lambda: "")
        shape = r.choice(["<li>{}<p>{}</p></li>", "<li>{}{}</li>", "<div>{}<p>{}</p></div>", "<p>{}{}</p>", "<article>{} <p>{}</p></article>"] if x < 0.85 else ['<div class="comment">{}{}</div>', "<li>{}<p>{}</p></li>"])
        items = "".join(shape.format(who(), self.prose(1, 4)) for _ in range(count))
        if "<li>" in shape:
            items = f"<{r.choice(['ul', 'ol'])}>{items}</ul>"
        title = r.choice([self.words(1), f"{self.words(1)} ({count})", f"{count} {self.words(1)}"])
        body = r.choice(["<h3>{}</h3>", "<h2>{}</h2>", "<h4>{}</h4>", "<h3>{}</h3>", "<div>{}</div>"]).format(title) + items + (self.form() if r.random() < 0.3 else "")
        if x < 0.7 and r.random() < 0.6:  # a heading with a number and lines that begin with names tell enough
            return f"<div>{r.choice(['<h3>', '<h2>'])}{self.words(1)} ({count})</h3>{items}</div>"
        return self.box("", "comments comment-list responses discussion disqus reader-comments replies", body)

    def paragraph(self) -> str:
        r = self.rng
        text = self.keep(self.prose(1, r.choice([1, 1, 3, 8, 12])))
        if r.random() < 0.15:
            words = text.split(" ")
            k = r.randrange(len(words))
            text = " ".join([*words[:k], f"<a href='y'>{words[k]}</a>", *words[k + 1 :]])
        style = r.random()
        return f"<p>{text}</p>" if style < 0.7 else f"<p>{text}" if style < 0.85 else f"<p><b>{text}<br>" if style < 0.93 else f"<div>{text}</div>"

    def article(self) -> str:
        r = self.rng
        parts = []
        sections = r.choice(["section", "section", "div"]) if r.random() < (0.25 if self.plain else 0.05) else ""
        if r.random() < (0.4 if self.plain else 0.85):
            title = f"<h1>{self.keep(self.words(r.randint(2, 12)))}</h1>"
            parts.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        if r.random() < 0.2:
            parts.append(f"<p class='byline'>{self.keep(self.words(3))}</p>")
        for _ in range(r.choice([1, 2, 2, 2, 3, 3, 4] if self.plain else [1, 1, 2, 3, 5, 8, 14])):
            x = r.random() * (0.72 if self.plain and r.random() < 0.75 else 1)
            if sections and x < 0.79:
                title = f"<h2>{self.keep(self.words(r.randint(1, 4)))}</h2>" if r.random() < 0.6 else ""
                parts.append(f"<{sections}>{title}{''.join(self.paragraph() for _ in range(r.choice([1, 1, 2])))}</{sections}>")
            elif x < 0.72:
                parts.append(self.paragraph())
            elif x < 0.79:
                parts.append(f"<h2>{self.keep(self.words(r.randint(1, 6)))}</h2>")
            elif x < 0.85:
                parts.append("<ul>" + "".join(f"<li>{self.keep(self.sentence())}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.87:
                parts.append(f"<blockquote><p>{self.keep(self.prose(1, 4))}</p></blockquote>")
            elif x < 0.885:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(r.randint(1, 4)))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.9:
                parts.append(f"<figure><img src=z><figcaption>{self.keep(self.sentence())}</figcaption></figure>")
            else:
                parts.append(r.choice([self.advert, self.advert, self.side, self.share, self.notice, self.form, self.unseen, self.unseen])())
        if not self.main:
            parts.append(self.paragraph())
        if r.random() < 0.1:
            parts.append(self.share())
        body = "".join(parts)
        x = r.random() * (0.4 if self.plain and r.random() < 0.2 else 1) + (0.5 if self.plain and r.random() < 0.7 else 0)
        if x < 0.5:
            body = f"<article{self.attribute('post entry article story') if r.random() < 0.3 else ''}>{body}</article>"
        elif x < 0.75:
            body = f"<div{self.attribute('content article post entry story post-body main-content text')}>{body}</div>"
        elif x < 0.85:
            body = f"<main>{body}</main>"
        elif x < 0.92 or self.plain and x < 1.05:
            body = f"<div{self.attribute('inhalt corpo zone box1 main-col text') if r.random() < 0.3 else ''}>{body}</div>"
        return body

    def page(self) -> str:
        r = self.rng
        maybe = lambda f, p: f() if r.random() < p else ""
        before = [maybe(self.head, 0.45), maybe(self.menu, 0.6), maybe(self.notice, 0.2), maybe(self.advert, 0.4), maybe(self.form, 0.15)]
        after = [maybe(self.comments, 0.3), maybe(self.side, 0.35), maybe(self.advert, 0.2), maybe(self.share, 0.15), maybe(self.foot, 0.75), maybe(self.notice, 0.15)]
        r.shuffle(before)
        after += [maybe(self.unseen, 0.06)]
        if self.plain:  # at most one thing besides the article
            before, after = [], []
            (before if r.random() < 0.3 else after).append(r.choice([lambda: "", lambda: "", self.foot, self.foot, self.foot, self.menu, self.comments, self.comments, self.comments, self.comments, self.advert, self.unseen])())
        middle = self.article()
        if r.random() < 0.25:
            middle = f"<div{self.attribute('wrapper container page row')}>{maybe(self.side, 0.4)}{middle}{maybe(self.comments, 0.25)}{maybe(self.side, 0.3)}</div>"
        elif r.random() < 0.1:
            middle = f"<table><tr><td>{self.side()}</td><td>{middle}</td></tr></table>"
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{''.join(before)}{middle}{''.join(after)}{end}"


def labelled_pages(count: int, seed: int = 5) -> Iterator[tuple[str, frozenset[str]]]:
    """Pages and the texts of their main blocks."""
    for k in range(count):
        writer = _Writer(random.Random(seed * 1_000_003 + k))
        page = writer.page()
        yield page, frozenset(writer.main)
