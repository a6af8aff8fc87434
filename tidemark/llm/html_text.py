"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is read once, tag by tag, into its leaf blocks: stretches of text between block-level tags, each with the path
of open elements around it. Features of a block are its ancestors' tags, word groups in their class and id, and plain
properties of the text (length, share of link text, closing punctuation, digits), none of which depends on a language.
The field has two states, text and boilerplate, and is fitted by gradient steps on its exact likelihood (forward and
backward sums) to labelled pages; Viterbi decoding gives the most likely sequence of states. The labelled pages are
made here, from a seed, by drawing page layouts whose blocks are known (`labelled_pages`).

Cases: a null page counts as empty and has no text; a page of boilerplate alone too; a tag or comment that is cut off at
the end is dropped; elements like svg that are closed at once or left open take no text with them; unknown and badly nested tags are tolerated; repeated rows get the same text; null ids are kept; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

# Tag names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|textarea|title"  # to the end of the page where they are left open
DROPPED = "noscript|template|iframe|select|svg|object|canvas"
GROUPS_OF_ROWS = [({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}), ({"td", "th"}, {"tr", "table"})]

# Words in class and id, by what they tend to hold.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toolbar pagination pager tabs skip toc",
    "top": "header masthead banner topbar logo branding hero",
    "bottom": "footer foot copyright legal colophon imprint bottom",
    "side": "sidebar aside widget related recommended popular trending rail more teaser promo-box tags tagcloud archive",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion adsense banner-ad commercial",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup paywall privacy",
    "comment": "comment comments commentlist discussion disqus reply replies respond responses thread feedback",
    "share": "share sharing social follow facebook twitter",
    "form": "form login search searchbox contact input signin register",
    "meta": "byline author date meta timestamp caption credit",
    "text": "article content post entry story body main text page prose maincontent article-body post-content entry-content",
}
_GROUP = {w: g for g, words in WORDS.items() for w in words.split()}

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<({DROPPED})(?=[\s/>])[^>]*(?<!/)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_WHOLE = re.compile(r"<[a-zA-Z]+((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in DROPPED.split("|")}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)?")


class Paths:
    """Paths of open elements, numbered as they come, with the names of their features.

    A path holds what its features need of the one above it, so that a deep page costs no more than a flat one.
    """

    def __init__(self):
        self.clear()

    def clear(self):
        self.child: dict = {}
        self.features: list[list[str]] = [[]]
        self.own: list[tuple] = [(frozenset(), frozenset(), "none", "none", False)]  # tags and groups around, nearest section and group, hidden

    def below(self, parent: int, tag: str, attributes: str) -> int:
        found = self.child.get((parent, tag, attributes))
        if found is None:
            own = frozenset(_groups(attributes)) if "=" in attributes else frozenset()
            tags, groups, near, inner, hidden = self.own[parent]
            hidden = hidden or (bool(attributes) and bool(re.search(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*.true", attributes, re.IGNORECASE)))
            tags, groups = tags | ({tag} & _AROUND), groups | own
            near, inner = tag if tag in _SECTION else near, min(own) if own else inner
            found = self.child[parent, tag, attributes] = len(self.own)
            self.own.append((tags, groups, near, inner, hidden))
            names = [f"in:{t}" for t in sorted(tags)] + [f"class:{g}" for g in sorted(groups)]
            self.features.append(names + [f"tag:{tag}", f"near:{near}", f"inner:{inner}"] + ["hidden"] * hidden)
        return found


def _groups(attributes: str):
    for m in _NAMED.finditer(attributes):
        for word in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1] or m[2] or m[3] or "").lower()):
            for w in (word, *word.split("-")):
                if w in _GROUP:
                    yield _GROUP[w]


_SECTION = {"article", "main", "nav", "header", "footer", "aside", "form", "section", "figure", "table", "body", "dialog"}
_AROUND = _SECTION | {"ul", "ol", "blockquote", "pre", "button", "label", "details"}


class Open:
    """The open elements, with the places of each name, so that none is looked for from the top."""

    def __init__(self):
        self.tags: list[str] = []
        self.numbers = [0]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, number: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.numbers.append(number)

    def cut(self, place: int) -> None:
        """Closes all elements from this place on."""
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            self.numbers.pop()

    def last(self, names) -> int:
        return max((found[-1] for name in names if (found := self.places.get(name))), default=-1)


def blocks(page: str | None, paths: Paths):
    """(path number, text, share of link text) of the page's leaf blocks, in order."""
    page, at, out = page or "", 0, []
    stack, held, size, linked, links = Open(), [], 0, 0, 0
    low = page.lower() if len(page.lower()) == len(page) else page
    ends = {name: low.rfind(f"</{name}") for name in _ENDS if f"<{name}" in low}  # where the last end tag can be

    def end():
        nonlocal held, size, linked
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((stack.numbers[-1], text, linked / max(size, 1)))
            held, size, linked = [], 0, 0

    start = 0
    while m := _TAG.search(page, start):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            size += len(piece)
            linked += len(piece) if links else 0
        at = start = m.end()
        if m[2]:
            name = m[2].lower()
            close = _ENDS[name].search(page, at, len(page)) if ends.get(name, -1) >= at else None
            if close:
                at = start = close.end()
            else:  # left open: a tag like any other
                ends[name] = -1
                whole = _WHOLE.match(page, m.start())
                at = start = max(at, whole.end() if whole else at)
            continue
        tag = m[4]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[3] else 1
            continue
        if tag not in BLOCK:
            continue
        end()
        if m[3]:
            if (place := stack.last((tag,))) >= 0:
                stack.cut(place)
            links = 0
            continue
        if tag in VOID:
            continue
        if stack.tags and stack.tags[-1] == "p" and tag != "br":
            stack.cut(len(stack.tags) - 1)
        for same, around in GROUPS_OF_ROWS:
            if tag in same and (place := stack.last(same)) >= 0 and place > stack.last(around - same):
                stack.cut(place)
        stack.push(tag, paths.below(stack.numbers[-1], tag, m[5].strip()))
    if at < len(page):
        piece = page[at:]
        held.append(piece)
        size += len(piece)
    end()
    return out


def text_features(text: str, link_share: float) -> tuple[str, ...]:
    words = text.count(" ") + 1
    bin_ = 0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 30 else 4
    link = "none" if not link_share else "some" if link_share < 0.5 else "most"
    return (
        f"words:{bin_}", f"links:{link}", f"end:{text[-1] in '.!?…»”'}", f"mark:{text[0] in '©®™'}", f"digits:{sum(map(str.isdigit, text[:60])) > 12}",
    )


@dataclass
class Field:
    weights: dict[str, float]  # of the state `text` against the other
    steps: np.ndarray  # [before, after]
    first: np.ndarray


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of every page and its main text (column text)."""
    field = fit(labelled_pages()) if field is None else field
    import pandas as pd

    def run(rows: pd.Series) -> pd.Series:
        paths, cache = Paths(), {}
        return pd.Series([main_text(p if isinstance(p, str) else None, field, paths, cache) for p in rows], dtype="str")

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return bounded_batches(pages).select(*keep, F.pandas_udf(run, "string")(F.col(html_col)).alias("text"))


def main_text(page: str | None, field: Field, paths: Paths, cache: dict) -> str:
    found = blocks(page, paths)
    if not found:
        return ""
    w, by_text = field.weights, cache.setdefault("text", {})
    by_path = cache.setdefault("path", {})
    scores = []
    for number, text, share in found:
        a = by_path.get(number)
        if a is None:
            a = by_path[number] = sum(w.get(f, 0.0) for f in paths.features[number])
        key = text_features(text, share)
        b = by_text.get(key)
        if b is None:
            b = by_text[key] = sum(w.get(f, 0.0) for f in key)
        scores.append(a + b)
    states = viterbi(scores, field)
    if len(paths.own) > 50_000:
        paths.clear()
        by_path.clear()
    return " ".join(t for (_, t, _), s in zip(found, states, strict=True) if s)


def viterbi(scores: list[float], field: Field) -> list[int]:
    """The most likely states; scores are those of state 1 against state 0."""
    (s00, s01), (s10, s11) = field.steps.tolist()
    no, yes = field.first[0], field.first[1] + scores[0]
    back = []
    for x in scores[1:]:
        n0, n1, y0, y1 = no + s00, yes + s10, no + s01, yes + s11
        back.append((n1 > n0, y1 > y0))
        no, yes = max(n0, n1), max(y0, y1) + x
    state = int(yes > no)
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def fit(labelled: list[tuple[str, list[int]]], steps: int = 150, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Fits the field to pages with the states of their blocks, by Adam on the likelihood."""
    paths, names, rows = Paths(), {}, []
    for page, states in labelled:
        found = blocks(page, paths)
        if len(found) != len(states):
            raise ValueError(f"{len(states)} labels for {len(found)} blocks")
        rows.append([[names.setdefault(f, len(names)) for f in (*paths.features[n], *text_features(t, s))] for n, t, s in found])
    most = max(map(len, rows))
    x = np.zeros((len(rows), most, len(names)), dtype=np.float32)
    y, mask = np.zeros((len(rows), most), dtype=int), np.zeros((len(rows), most), dtype=bool)
    for i, (page, (_, states)) in enumerate(zip(rows, labelled, strict=True)):
        for j, fs in enumerate(page):
            x[i, j, fs] = 1
        y[i, : len(states)], mask[i, : len(states)] = states, True
    size = len(names)
    w, m, v = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    for t in range(1, steps + 1):
        g = _gradient(w, x, y, mask, size) / len(rows) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field({f: float(w[k]) for f, k in names.items()}, w[size : size + 4].reshape(2, 2), w[size + 4 :])


def _gradient(w, x, y, mask, size):
    """Of the negative log-likelihood: expected less observed counts, by forward and backward sums over all pages."""
    pages, most = y.shape
    emit = np.zeros((pages, most, 2))
    emit[..., 1] = x @ w[:size].astype(np.float32)
    step, first = w[size : size + 4].reshape(2, 2), w[size + 4 :]
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = first + emit[:, 0]
    for t in range(1, most):
        new = np.logaddexp(ahead[:, t - 1, :1] + step[0], ahead[:, t - 1, 1:] + step[1]) + emit[:, t]
        ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
    for t in range(most - 2, -1, -1):
        after = emit[:, t + 1] + behind[:, t + 1]
        new = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
        behind[:, t] = np.where(mask[:, t + 1, None], new, 0)
    whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p = np.exp(ahead + behind - whole[:, None, None])[..., 1] * mask
    g = np.zeros_like(w)
    g[:size] = np.tensordot(p - y * mask, x, ((0, 1), (0, 1)))
    pair = ahead[:, :-1, :, None] + step + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    g[size : size + 4] = (np.exp(pair[mask[:, 1:]]).sum(0) - seen).ravel()
    start = p[:, 0][mask[:, 0]].sum()
    g[size + 4 :] = [mask[:, 0].sum() - start - (y[:, 0] == 0)[mask[:, 0]].sum(), start - y[:, 0][mask[:, 0]].sum()]
    return g


def labelled_pages(n: int = 500, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages of random layouts with the state (1: text) of each leaf block."""
    r = random.Random(seed)
    return [_Drawn(r).page() for _ in range(n)]


class _Drawn:
    def __init__(self, r: random.Random):
        self.r, self.states = r, []

    def words(self, low: int, high: int, stop: str = ".") -> str:
        make = lambda: "".join(self.r.choice("bcdfglmnprst") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4)))
        return " ".join(make() for _ in range(self.r.randint(low, high))).capitalize() + stop

    def block(self, tag: str, text: str, state: int, attributes: str = "") -> str:
        self.states.append(state)
        return f"<{tag}{attributes}>{text}</{tag}>"

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/x">{self.words(low, high, "")}</a>'

    def named(self, group: str, tag: str | None = None) -> str:
        name = self.r.choice([w for w in WORDS[group].split()])
        return f'{self.r.choice(["class", "id"])}="{self.r.choice(["", "x ", "site "])}{name}"'

    def menu(self, tag: str, attributes: str) -> str:
        rows = "".join(self.block("li", self.link(), 0) for _ in range(self.r.randint(2, 8)))
        return f"<{tag} {attributes}><ul>{rows}</ul></{tag}>"

    def short(self, tag: str, attributes: str, low: int = 3, high: int = 25) -> str:
        inner = self.r.choice(["div", "p", "span"])
        text = self.words(low, high, self.r.choice([".", "", "!"]))
        self.states.append(0)
        return f"<{tag} {attributes}>{text if inner == 'span' else f'<{inner}>{text}</{inner}>'}</{tag}>"

    def comments(self) -> str:
        rows = "".join(self.block(self.r.choice(["p", "li", "div"]), self.words(3, 60), 0) for _ in range(self.r.randint(1, 5)))
        head = self.block("h3", self.words(1, 3, ""), 0) if self.r.random() < 0.6 else ""
        return f"<{self.r.choice(['div', 'section'])} {self.named('comment')}>{head}{rows}</div>"

    def form(self) -> str:
        label = self.block("label", self.words(1, 4, ""), 0) if self.r.random() < 0.6 else ""
        return f"<form>{label}{self.block('p', self.words(2, 12), 0)}<input name=q></form>"

    def boilerplate(self, inside: bool) -> str:
        kind = self.r.choice(["advert", "notice", "share", "form", "side", "menu"] + ["comments"] * inside)
        if kind == "comments":
            return self.comments()
        if kind == "form":
            return self.form()
        if kind == "share":
            return self.menu("div", self.named("share"))
        if kind == "menu":
            return self.menu(self.r.choice(["nav", "div"]), self.named("menu"))
        if kind == "side":
            return self.r.choice([self.menu, self.short])(self.r.choice(["aside", "div"]), self.named("side"))
        return self.short(self.r.choice(["div", "section", "aside"]), self.named(kind), 3, 40)

    def article(self) -> str:
        out = [self.block("h1", self.words(2, 12, self.r.choice(["", ".", " |"])), 1)] if self.r.random() < 0.85 else []
        for _ in range(self.r.randint(1, 12)):
            draw = self.r.random()
            if draw < 0.75:
                text = self.words(1, 90, self.r.choice([".", ".", ".", "", " |"]))
                if self.r.random() < 0.2:
                    text += f" {self.link()} {self.words(1, 9)}"
                out.append(self.block("p", self.r.choice(["", "<b>"]) + text, 1))
            elif draw < 0.82:
                out.append(self.block(self.r.choice(["h2", "h3"]), self.words(1, 8, ""), 1))
            elif draw < 0.88:
                out.append("<ul>" + "".join(self.block("li", self.words(2, 25), 1) for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif draw < 0.92:
                out.append("<blockquote>" + self.block("p", self.words(5, 40), 1) + "</blockquote>")
            elif draw < 0.95:
                out.append("<table><tr>" + "".join(self.block("td", self.words(1, 6, ""), 1) for _ in range(2)) + "</tr></table>")
            else:
                out.append(self.boilerplate(True))
        if self.r.random() < 0.15:
            out.append(self.comments())
        body = "".join(out)
        kind = self.r.random()
        if kind < 0.5:
            return f"<article>{body}</article>"
        if kind < 0.65:
            return f"<main>{body}</main>"
        if kind < 0.9:
            return f"<div {self.named('text')}>{body}</div>"
        return f"<div>{body}</div>"

    def page(self) -> tuple[str, list[int]]:
        r, out = self.r, []
        if r.random() < 0.5:
            out.append(self.short("header", "", 1, 8) if r.random() < 0.5 else self.short("div", self.named("top"), 1, 8))
        if r.random() < 0.8:
            out.append(self.menu("nav", "") if r.random() < 0.6 else self.menu("div", self.named("menu")))
        for _ in range(r.randint(0, 2)):
            out.append(self.boilerplate(False))
        if r.random() < 0.95:
            out.append(self.article())
        for _ in range(r.randint(0, 2)):
            out.append(self.boilerplate(False))
        if r.random() < 0.3:
            out.append(self.comments())
        if r.random() < 0.85:
            text = r.choice(["&copy; ", "", ""]) + self.words(2, 20, r.choice([".", ""]))
            out.append(self.block("footer", text, 0) if r.random() < 0.7 else self.block("div", text, 0, " " + self.named("bottom")))
        if not self.states:
            return self.page()
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{}}</style></head><body>{''.join(out)}</body></html>", self.states
