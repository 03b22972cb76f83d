"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table
from .html_blocks import Block, leaf_blocks

# ------------------------------------------------------------------- features


def _bucket(n: float, cuts: tuple[float, ...]) -> int:
    return sum(n >= c for c in cuts)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block: ancestors, their names, and its text."""
    core = any(t in ("article", "main") for b in blocks for t in b.tags)
    out = []
    for b in blocks:
        n, share = len(b.text.split()), b.linked / max(1, len(b.text))
        end = b.text[-1]
        near = [t for t in b.tags if t not in ("html", "body")]
        f = {"bias", f"tag={b.tags[-1] if b.tags else ''}", f"words={_bucket(n, (2, 4, 7, 12, 25, 60))}", f"linked={_bucket(share, (0.01, 0.3, 0.7, 0.95))}"}
        f |= {f"in={t}" for t in near} | {f"name={x}" for x in b.names}
        f.add("ends=" + ("stop" if end in ".?!…。" else "comma" if end in ",;:" else "letter" if end.isalpha() else "other"))
        f.add(f"depth={_bucket(len(near), (1, 2, 3, 4, 6))}")
        if core and not any(t in ("article", "main") for t in near):
            f.add("outside core")
        if "©" in b.text or "(c)" in b.text.lower():
            f.add("copyright")
        if b.text.isupper():
            f.add("capitals")
        out.append(sorted(f))
    return out


def links(blocks: list[Block]) -> list[int]:
    """Kind of the step into each block: 1 if it has the parent of the one before."""
    return [int(i > 0 and b.parent == blocks[i - 1].parent) for i, b in enumerate(blocks)]


# ------------------------------------------------------------------------ model


@dataclass
class ChainModel:
    """Weights of (feature, label) and of (kind of step, label before, label)."""

    weights: dict[str, tuple[float, float]]
    steps: list[list[list[float]]]

    def labels(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of all blocks together, by Viterbi."""
        if not blocks:
            return []
        none = (0.0, 0.0)
        back: list[tuple[int, int]] = []
        before = none
        for i, (names, kind) in enumerate(zip(features(blocks), links(blocks), strict=True)):
            e0 = e1 = 0.0
            for name in names:
                w = self.weights.get(name, none)
                e0 += w[0]
                e1 += w[1]
            if not i:
                before = (e0, e1)
                continue
            t = self.steps[kind]
            a0, a1, b0, b1 = before[0] + t[0][0], before[1] + t[1][0], before[0] + t[0][1], before[1] + t[1][1]
            back.append((int(a1 > a0), int(b1 > b0)))
            before = (max(a0, a1) + e0, max(b0, b1) + e1)
        out = [int(before[1] > before[0])]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _marginals(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels and of label pairs from emissions and each step's weights."""
    n = len(e)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = e[0]
    for i in range(1, n):
        a[i] = e[i] + np.logaddexp(a[i - 1, 0] + t[i, 0], a[i - 1, 1] + t[i, 1])
    for i in range(n - 2, -1, -1):
        x = t[i + 1] + (e[i + 1] + b[i + 1])
        b[i] = np.logaddexp(x[:, 0], x[:, 1])
    z = np.logaddexp(a[-1, 0], a[-1, 1])
    pairs = np.exp(a[:-1, :, None] + t[1:] + (e[1:] + b[1:])[:, None, :] - z)
    return np.exp(a + b - z), pairs


def fit_chain(pages: list[tuple[list[Block], list[int]]], *, rounds: int = 6, rate: float = 0.3, l2: float = 1e-4) -> ChainModel:
    """Maximise the likelihood of labelled pages by scaled gradient steps, page by page."""
    ids: dict[str, int] = {}
    data = []
    for blocks, labels in pages:
        if blocks:
            rows = [[ids.setdefault(n, len(ids)) for n in f] for f in features(blocks)]
            data.append((np.concatenate(rows), np.array([len(r) for r in rows]), np.array(links(blocks)), np.array(labels)))
    w, s = np.zeros((len(ids), 2)), np.zeros((2, 2, 2))
    gw, gs = np.full_like(w, 1e-2), np.full_like(s, 1e-2)
    order = random.Random(7)
    for _ in range(rounds):
        order.shuffle(data)
        for flat, sizes, kinds, y in data:
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            one, pairs = _marginals(np.add.reduceat(w[flat], at, axis=0), s[kinds])
            want = np.zeros_like(one)
            want[np.arange(len(y)), y] = 1
            g = np.zeros_like(w)
            np.add.at(g, flat, np.repeat(want - one, sizes, axis=0))
            g -= l2 * w
            gw += g * g
            w += rate * g / np.sqrt(gw)
            h = np.zeros_like(s)
            if len(y) > 1:
                np.add.at(h, (kinds[1:], y[:-1], y[1:]), 1)
                np.subtract.at(h, kinds[1:], pairs)
            gs += h * h
            s += rate * h / np.sqrt(gs)
    return ChainModel({n: (float(w[i, 0]), float(w[i, 1])) for n, i in ids.items()}, s.tolist())


# --------------------------------------------------------------- labelled pages

_MARK = "⁣"  # stands before each text of the article while a page is made, and is no part of it


class _PageMaker:
    """Pages of many layouts whose article texts are known."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(("ra", "el", "to", "mi", "sen", "ver", "qu", "ña", "ö", "the", "and", "br", "ist", "ou", "é", "kal")) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(1, 18).capitalize() + self.r.choice((".", ".", ".", "?", "!", ","))

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 4)}</a>'

    def some(self, make, low: int, high: int, join: str = "") -> str:
        return join.join(make() for _ in range(self.r.randint(low, high)))

    def named(self, tags: tuple[str, ...], names: tuple[str, ...], inside: str) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        attribute = self.r.choice(("class", "class", "id"))
        if tag not in ("div", "section", "span", "p", "ul") and self.r.random() < 0.6:
            return f"<{tag}>{inside}</{tag}>"
        return f'<{tag} {attribute}="{name}">{inside}</{tag}>'

    def part(self) -> str:
        """One block of the article."""
        k = self.r.random()
        if k < 0.68:
            text = self.prose()
            if self.r.random() < 0.2:
                text += f' <a href="#">{self.words(1, 3)}</a> <em>{self.sentence()}</em>'
            return self.r.choice((f"<p>{_MARK}{text}</p>", f"<p>{_MARK}{text}</p>", f"<p>{_MARK}{text}", f"<p><b>{_MARK}{text}<br>", f"<div>{_MARK}{text}</div>"))
        if k < 0.78:
            level = self.r.randint(2, 4)
            return f"<h{level}>{_MARK}{self.words(1, 9)}</h{level}>"
        if k < 0.86:
            return "<ul>" + self.some(lambda: f"<li>{_MARK}{self.r.choice((self.sentence, lambda: self.words(1, 5)))()}</li>", 2, 5) + "</ul>"
        if k < 0.92:
            return f"<blockquote>{_MARK}{self.prose(3)}</blockquote>"
        if k < 0.96:
            return "<table>" + self.some(lambda: "<tr>" + self.some(lambda: f"<td>{_MARK}{self.words(1, 3)}</td>", 2, 3) + "</tr>", 1, 3) + "</table>"
        return f"<pre>{_MARK}{self.words(3, 20)}</pre>"

    def aside(self) -> str:
        """Something that may also stand inside the article's element."""
        return self.r.choice((self.advert, self.share, self.related, self.form, self.notice))()

    def advert(self) -> str:
        return self.named(("div", "aside", "section", "ins"), ("ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "banner ad-slot", "adsbox"), self.r.choice((self.sentence(), self.prose(2), f"<p>{self.prose(2)}</p>", self.link())))

    def share(self) -> str:
        return self.named(("div", "ul"), ("share", "social", "share-buttons", "social-links", "toolbar"), self.some(self.link, 2, 5, " "))

    def related(self) -> str:
        return self.named(("div", "section", "aside"), ("related", "related-posts", "recommended", "more-stories", "read-next", "popular"), f"<h3>{self.words(1, 3)}</h3><ul>" + self.some(lambda: f"<li>{self.link()}</li>", 2, 6) + "</ul>")

    def form(self) -> str:
        return "<form>" + self.r.choice((f"<label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button>", f"<p>{self.prose(2)}</p><input type=email><button>{self.word()}</button>", f"<h4>{self.words(2, 4)}</h4><p>{self.sentence()}</p>")) + "</form>"

    def notice(self) -> str:
        return self.named(("div", "section", "aside", "p"), ("cookie-notice", "cookie", "cookies-banner", "consent", "notice", "gdpr", "alert", "newsletter", "subscribe", "paywall", "popup modal", "disclaimer"), self.r.choice((f"<p>{self.prose(2)}</p>", self.prose(3))) + f"<button>{self.word()}</button>" * self.r.randint(0, 1))

    def menu(self) -> str:
        inside = self.r.choice(("<ul>" + self.some(lambda: f"<li>{self.link()}</li>", 3, 8) + "</ul>", self.some(self.link, 3, 7, " | ")))
        return self.named(("nav", "nav", "div", "ul"), ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "main-menu", "topbar", "pagination"), inside)

    def header(self) -> str:
        return self.named(("header", "header", "div"), ("header", "site-header", "masthead", "branding", "top"), self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<a href=/>{self.words(1, 3)}</a>")) + f"<p>{self.sentence()}</p>" * self.r.randint(0, 1) + (self.menu() if self.r.random() < 0.4 else ""))

    def sidebar(self) -> str:
        return self.named(("aside", "aside", "div"), ("sidebar", "side", "widget", "widget-area", "right-column", "rail"), self.some(lambda: self.r.choice((f"<h3>{self.words(1, 3)}</h3>", f"<p>{self.prose(2)}</p>", self.related(), self.form(), "<ul>" + self.some(lambda: f"<li>{self.link()}</li>", 2, 5) + "</ul>")), 1, 4))

    def comments(self) -> str:
        one = lambda: self.r.choice((f'<article class="comment"><p>{self.prose(3)}</p></article>', f'<div class="comment"><b>{self.word()}</b><p>{self.prose(3)}</p></div>', f"<li><p>{self.prose(3)}</p></li>", f"<p>{self.word()}: {self.prose(2)}</p>"))
        return self.named(("section", "div"), ("comments", "comment-list", "reader-comments", "discussion", "replies", "responses", "disqus_thread"), f"<h3>{self.words(1, 3)}</h3>" * self.r.randint(0, 1) + self.some(one, 1, 5))

    def footer(self) -> str:
        return self.named(("footer", "footer", "div"), ("footer", "site-footer", "bottom", "copyright", "colophon", "legal"), self.r.choice((f"&copy; {self.word()}.example &middot; {self.prose(2)}", f"<p>&copy; 2024 {self.words(1, 3)}</p>", self.some(self.link, 2, 5, " "), f"<p>{self.prose(2)}</p>")))

    def page(self) -> str:
        r = self.r
        title = self.words(2, 10)
        heading = f"<h1>{_MARK}{title}</h1>" if r.random() < 0.85 else ""
        parts = [self.part() for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20)))]
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), self.aside())
        if r.random() < 0.1:
            parts.append(self.comments())
        body = heading + "".join(parts)
        core = r.choice(("<article>{}</article>",) * 5 + ("<main>{}</main>", "<main><article>{}</article></main>", '<article class="post">{}</article>', '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="post entry">{}</div>', '<div class="article-body">{}</div>', '<div id="main" role="main">{}</div>', '<section class="story">{}</section>')).format(body)
        k = r.random()
        if k < 0.1:
            # nothing but the article: its blocks, or text alone
            return f"<html><body>{body}</body></html>" if k < 0.07 else f"{_MARK}{self.prose(8)}"
        if k < 0.25:
            core = body  # no element of its own
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.sidebar, self.form) if r.random() < 0.4]
        after = [f() for f in (self.comments, self.related, self.sidebar, self.advert, self.share, self.notice, self.form) if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.9:
            after.append(self.footer())
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"

    def labelled(self) -> tuple[list[Block], list[int]]:
        blocks = leaf_blocks(self.page())
        labels = [int(_MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(_MARK, "")
        kept = [i for i, b in enumerate(blocks) if b.text]
        return [blocks[i] for i in kept], [labels[i] for i in kept]


@lru_cache(2)
def trained_model(pages: int = 700, seed: int = 11) -> ChainModel:
    """The field fitted on made pages of many layouts, whose labels are known."""
    maker = _PageMaker(seed)
    return fit_chain([maker.labelled() for _ in range(pages)])


# ---------------------------------------------------------------------- operator


def main_text(page: str | None, model: ChainModel) -> str:
    """Texts of the blocks labelled as the article's, one a line."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, model.labels(blocks), strict=True) if y)


def extract_text(pages: DataFrame, model: ChainModel | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article's text of every page.

    A null page is empty and gives the empty text; so does a page without an
    article. Null ids and addresses stay null; repeated rows give repeated rows;
    an empty table gives none; other columns are not read.
    """
    model = model or trained_model()

    def work(x: dict[str, list]) -> dict[str, object]:
        texts = [main_text(h, model) for h in x[html_col]]
        return {"page_id": x[id_col], "url": x[url_col], "text": texts, "n_chars": list(map(len, texts))}

    return map_texts(pages, [id_col, url_col, html_col], "page_id long, url string, text string, n_chars long", work)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract_text(table(spark, sf_dir, "pages"))
