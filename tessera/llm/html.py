"""Main-text extraction with a linear-chain conditional random field.

A page becomes a sequence of leaf blocks (runs of text between block-level
tags).  Each block is described by its ancestors' tags, their class and id
words, and its text; the field adds the tendency of neighbours to agree.  It
is trained on labelled pages made by ``labelled_pages`` (pages of many layouts,
written with their labels) and decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import slices
from .common import without

#: Fixed sets of HTML: elements that never close, that hold no visible text, and that flow inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
#: Of these, those that a closing slash leaves empty, and those whose tag alone goes if no end tag follows.
FOREIGN = frozenset({"svg", "math"})
OPEN_ALONE = FOREIGN | {"noscript", "template"}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag of the key closes an open element of the value, up to the nearest container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table article section main aside nav header footer div form body td th blockquote figure details".split())
#: Any of these closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)

_OPENS = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: The end of a tag, or an attribute's quoted value, which may hold one.
_STEP = re.compile(r">|=[ \t\n\r\f]*(?:\"[^\"]*\"|'[^']*')")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_BLANK = re.compile(r"[ \t\n\r\f\v ]+")


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    leaf: str
    names: frozenset[str]
    linked: int


class Tags:
    """The tags of a page in order, each found in time that all of them share.

    A quoted value ends a tag's search for ``>`` only where it is closed; if the
    quotes leave no end at all, the next ``>`` is taken from there on.
    """

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def _end(self, at: int) -> int:
        """Where the ``>`` of the tag is whose name ends at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        step = at
        while self.quotes and (match := _STEP.search(self.html, step)):
            if match[0] == ">":
                return match.start()
            step = match.end()
        self.quotes = False
        return self.html.find(">", at)

    def __call__(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Begin, end, whether it closes, lower-cased name (None: a comment or the like) and attributes."""
        html = self.html
        while (begin := html.find("<", at)) >= 0:
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                return begin, len(html) if end < 0 else end + 3, False, None, ""
            if match := _OPENS.match(html, begin):
                if (end := self._end(match.end())) >= 0:
                    return begin, end + 1, bool(match[1]), match[2].lower(), html[match.end() : end]
            elif html[begin + 1 : begin + 2] in ("!", "?", "/") and (end := html.find(">", begin) if begin < self.last else -1) >= 0:
                return begin, end + 1, False, None, ""
            at = begin + 1
        return None


class Ancestors:
    """The open elements, with what is asked of them kept up to date as they come and go."""

    def __init__(self, known: Callable[[str], bool] | None):
        self.known = known
        self.stack: list[tuple[str, frozenset[str], frozenset[str]]] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, name: str, names: set[str]) -> None:
        tags, held = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (frozenset(), frozenset())
        if name not in tags and (not self.known or self.known(f"in={name}")):
            tags |= {name}
        new = {n for n in names if n not in held and (not self.known or self.known(f"name={n}"))}
        self.places.setdefault(name, []).append(len(self.stack))
        if name in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((name, tags, held | new if new else held))

    def top(self) -> tuple[frozenset[str], str, frozenset[str]]:
        name, tags, names = self.stack[-1] if self.stack else ("", frozenset(), frozenset())
        return tags, name, names

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def cut(self, at: int) -> None:
        """Close the element at ``at`` and all inside it."""
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in CONTAINERS:
                self.containers.pop()

    @property
    def container(self) -> int:
        return self.containers[-1] if self.containers else -1


def leaf_blocks(html: str, known: Callable[[str], bool] | None = None) -> list[Block]:
    """Visible leaf blocks in page order; tolerant of unclosed and stray tags.

    Time and memory grow with the page, however deep its elements nest and
    whatever its quotes.  With ``known``, tags and names that are no known
    feature are left out of the blocks.
    """
    out: list[Block] = []
    open_, tag = Ancestors(known), Tags(html)
    parts: list[str] = []
    unclosed: set[str] = set()
    linked = at = 0

    def flush() -> None:
        nonlocal parts, linked
        text = _BLANK.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, *open_.top(), linked))
        parts, linked = [], 0

    while found := tag(at):
        begin, end, closes, name, attributes = found
        if begin > at:
            parts.append(html[at:begin])
            if open_.last("a") >= 0:
                linked += begin - at
        at = end
        if name is None:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if closes:
            if name not in INLINE:
                flush()
            where = open_.last(name)
            if where >= 0 and (name not in INLINE or open_.container <= where):
                open_.cut(where)
            continue
        if name not in INLINE and name not in RAW:
            flush()
        if name in RAW:
            if name in FOREIGN and attributes.endswith("/"):
                continue
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not close:
                unclosed.add(name)
            if close or name not in OPEN_ALONE:
                at = close.end() if close else len(html)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        closed = CLOSES.get(name, frozenset()) | ({"p"} if name in CLOSES_P else frozenset())
        if closed:
            where = max(open_.last(n) for n in closed)
            if where >= max(0, open_.container):
                open_.cut(where)
        names = {w.lower() for m in _NAME.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")} if attributes else set()
        open_.push(name, names)
    parts.append(html[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for block in blocks:
        words = block.text.count(" ") + 1
        own = [f"in={t}" for t in sorted(block.tags)] + [f"name={n}" for n in sorted(block.names)]
        own.append(f"leaf={block.leaf}")
        own.append(f"words={min(8, words.bit_length())}")
        own.append(f"links={min(4, 4 * block.linked // max(1, len(block.text)))}")
        if block.text[-1:] in ".!?:;。！？":
            own.append("ends")
        if "©" in block.text or "copyright" in block.text.lower():
            own.append("rights")
        out.append(own)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of a two-label chain: 0 outside, 1 main text."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        get, emit = self.index.get, self.emit.tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.first.tolist()
        back: list[tuple[int, int]] = []
        for number, row in enumerate(rows):
            if number:
                from0, from1 = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10), (0, a + m01) if a + m01 > b + m11 else (1, b + m11)
                back.append((from0[0], from1[0]))
                a, b = from0[1], from1[1]
            for name in row:
                if (i := get(name)) is not None:
                    a += emit[i][0]
                    b += emit[i][1]
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 250, rate: float = 0.1, l2: float = 2e-4) -> Field:
    """Maximise the regularised conditional likelihood with Adam; exact forward-backward."""
    index: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for name in row:
                index.setdefault(name, len(index))
    longest = max(len(rows) for rows, _ in pages)
    shape = (len(pages), longest)
    mask, gold = np.zeros(shape, bool), np.zeros(shape, np.int64)
    cells, names = [], []
    for p, (rows, labels) in enumerate(pages):
        mask[p, : len(rows)] = True
        gold[p, : len(rows)] = labels
        for t, row in enumerate(rows):
            cells.extend([p * longest + t] * len(row))
            names.extend(index[n] for n in row)
    cells, names = np.array(cells), np.array(names)
    n = len(index)
    theta = np.zeros(2 * n + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    one_hot = np.eye(2)[gold] * mask[..., None]
    for step in range(1, steps + 1):
        emit, move, first = theta[: 2 * n].reshape(n, 2), theta[2 * n : 2 * n + 4].reshape(2, 2), theta[2 * n + 4 :]
        score = np.stack([np.bincount(cells, emit[names, k], shape[0] * shape[1]).reshape(shape) for k in (0, 1)], -1)
        alpha, beta = np.zeros((*shape, 2)), np.zeros((*shape, 2))
        alpha[:, 0] = score[:, 0] + first
        for t in range(1, longest):
            new = np.logaddexp(*(alpha[:, t - 1, None, k] + move[k][None, :] for k in (0, 1))) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(*(move[:, k][None, :] + ahead[:, k, None] for k in (0, 1)))
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        prob = np.exp(alpha + beta - norm[:, None, None]) * mask[..., None]
        diff = one_hot - prob
        g_emit = np.stack([np.bincount(names, diff[..., k].ravel()[cells], n) for k in (0, 1)], -1)
        joint = alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - norm[:, None, None, None]
        joint = np.exp(np.where(mask[:, 1:, None, None], joint, -np.inf))
        g_move = np.einsum("ptj,ptk->jk", one_hot[:, :-1], one_hot[:, 1:]) - joint.sum((0, 1))
        g = np.concatenate((g_emit.ravel(), g_move.ravel(), diff[:, 0].sum(0))) / len(pages) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, theta[: 2 * n].reshape(n, 2), theta[2 * n : 2 * n + 4].reshape(2, 2), theta[2 * n + 4 :])


def labelled_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages of many layouts with the main blocks' texts, for training and held-out tests."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        return words(4, 30).capitalize() + rng.choice(".....!?")

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"

    def aside() -> str:
        text = sentence() if rng.random() < 0.6 else words(1, 6)
        body = rng.choice([f"<p>{text}</p>", text, f"<h3>{words(1, 3)}</h3>{menu()}", f"<span>{text}</span>"])
        name = rng.choice(
            ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "sidebar", "related", "share", "social", "widget", "cookie", "cookie-notice", "notice", "consent", "popup", "newsletter", "subscribe", "breadcrumb", "menu", "navbar", "pagination", "tags", "login", "toolbar"]
        )
        tag = rng.choice(["div", "div", "aside", "section"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">{body}</{tag}>'

    def form() -> str:
        return f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button><p>{sentence()}</p></form>"

    def comments() -> str:
        name = rng.choice(["comments", "comment-list", "replies", "respond", "discussion"])
        return f'<{rng.choice(["div", "section"])} class="{name}"><h3>{words(1, 3)}</h3>' + "".join(
            f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 5))
        ) + "</div>"

    def main_block(say) -> str:
        kind = rng.random()
        if kind < 0.1:
            return f"<h{(k := rng.randint(1, 4))}>{say(words(1, 9))}</h{k}>"
        if kind < 0.16:
            return "<ul>" + "".join(f"<li>{say(words(2, 14))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.2:
            return f"<blockquote><p>{say(sentence())}</p></blockquote>"
        if kind < 0.23:
            return f"<pre>{say(words(3, 20))}</pre>"
        if kind < 0.26:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{say(words(1, 5))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 6])))
        say(text)
        if kind < 0.36:
            first, _, rest = text.partition(" ")
            text = f"<{(k := rng.choice(['b', 'em', 'a', 'strong']))}>{first}</{k}> {rest}"
        return f"<p>{text}" + ("</p>" if rng.random() < 0.8 else "")

    pages = []
    for _ in range(count):
        told: list[str] = []

        def say(text: str, told: list[str] = told) -> str:
            told.append(text)
            return text

        top = "".join(rng.sample([f"<nav>{menu()}</nav>", f"<header><p>{words(1, 5)}</p>{menu()}</header>", aside(), aside(), form()], rng.randint(0, 4)))
        title = f"<h1>{say(words(2, 10))}</h1>" if rng.random() < 0.8 else ""
        body = title + "".join(main_block(say) + (aside() if rng.random() < 0.12 else "") for _ in range(rng.randint(0 if title else 1, 12)))
        opening, closing = rng.choice(
            [("<article>", "</article>")] * 5
            + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post"><div class="entry">', "</div></div>"), ('<section class="article-body">', "</section>"), ("<div>", "</div>")]
        )
        low = "".join(rng.sample([comments(), aside(), aside(), form(), f"<footer><p>&copy; {words(1, 4)} &middot; {sentence()}</p></footer>", f"<footer>&copy; {words(1, 4)} {sentence()}</footer>"], rng.randint(0, 5)))
        pages.append((f"<html><head><title>{words(1, 5)}</title></head><body>{top}{opening}{body}{closing}{low}</body></html>", told))
    return pages


def label_blocks(blocks: list[Block], told: list[str]) -> list[int]:
    wanted = [_BLANK.sub(" ", t).strip() for t in told]
    labels, at = [], 0
    for block in blocks:
        hit = at < len(wanted) and block.text == wanted[at]
        labels.append(int(hit))
        at += hit
    return labels


@lru_cache(maxsize=2)
def trained(count: int = 400, seed: int = 7) -> Field:
    """The field of the built-in labelled pages; deterministic."""
    pages = []
    for html, told in labelled_pages(count, seed):
        blocks = leaf_blocks(html)
        if blocks:
            pages.append((features(blocks), label_blocks(blocks, told)))
    return fit(pages)


def main_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html, field.index.__contains__)
    return " ".join(b.text for b, label in zip(blocks, field.decode(features(blocks)), strict=True) if label)


def extract(pages: DataFrame, html: str = "html", field: Field | None = None) -> DataFrame:
    """Every row with ``text string`` (empty if none; a column of that name is replaced); null html is empty.

    No shuffle.  The field travels with the task: a weight per feature of the
    labelled pages, whatever the size of the input.
    """
    pages = without(pages, ["text"])
    model = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts = [main_text(h or "", model) for h in part.column(part.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())]))
