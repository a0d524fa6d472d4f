"""Main text of web pages by a recurrent block labeller.

A page becomes its blocks in order: a block is the text between two block-level
tags, with the path of open tags (names, classes, ids) above it. A bidirectional
LSTM in numpy reads a vector per block (hashed path parts, hashed words, length,
link share, place) and labels every block as main text or not, with the whole
page as context. The page's text is its main blocks in order.

The network is trained here, on a bounded sample of pages (``SAMPLE``). Its
labels come from the markup's own meaning (``_teacher``: an article's text
outside of navigation, footers, notices, forms and the like), and the sampled
pages are varied: containers take other names for the same thing, and menus,
notices, comments and adverts are put in at other places, so that the network
learns many forms of both and not one template.

Pages run in Arrow batches, in groups of similar length, of whole pages; no
shuffle. Rows: null or empty html has no text; text outside any tag is a block
of its own; unclosed and stray tags are tolerated; repeated pages give repeated
rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import bounded_sample

#: Pages that the training may use.
SAMPLE = 240
PATH, WORDS, NUMBERS, HIDDEN = 64, 32, 4, 12
#: Cells (blocks of the longest page times pages) that run through the network at once.
CELLS = 40_000
#: The rest of a tag: ``>`` inside a quoted attribute value does not end it.
_REST = r"""(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+>"""
_token = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea)\b" + _REST + r".*?(?:</\1\s*>|$)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z]" + _REST, re.S | re.I)
_name = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_mark = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_part = re.compile(r"[a-z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A start tag that ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
MAIN = {"article", "main"}
OTHER_TAGS = {"nav", "footer", "header", "aside", "form", "button", "select", "menu", "dialog", "head", "title", "label", "iframe"}
OTHER_MARKS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent", "cookie", "cookies", "footer", "header", "menu", "modal", "nav", "navbar",
               "newsletter", "notice", "notices", "popup", "promo", "related", "replies", "reply", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget", "alert", "disclaimer"}
CONTENT_MARKS = ["content", "post", "story", "entry", "body", "text", "main", "article"]


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    inside = 0
    said_some = False  # whether pieces hold more than blanks
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal inside, said_some
        said_some = False
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, path, inside / max(1, sum(map(len, pieces)))))
            pieces.clear()
        inside = 0

    def text(raw: str) -> None:
        nonlocal inside, path, said_some
        if not raw:
            return
        said = entities.unescape(raw) if "&" in raw else raw
        if not said_some:
            path = tuple(x for _, parts in stack for x in parts)
        pieces.append(said)
        said_some = said_some or not said.isspace()
        if any(n == "a" for n, _ in stack):
            inside += len(said)

    at = 0
    for m in _token.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = m.group()
        if m.group(1):  # raw text elements say nothing
            flush()
            continue
        named = _name.match(tag)
        if not named:
            continue
        name = named.group(1).lower()
        if name in VOID:
            if name in ("br", "wbr"):
                if pieces and name == "br":
                    pieces.append(" ")
            elif name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
        if tag[1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in ("p",):
                    break
        marks = [x for g in _mark.findall(tag) for x in _part.findall("".join(g).lower())] if "=" in tag else []
        stack.append((name, (name, *(f".{x}" for x in marks))))
    text(page[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A vector per block: hashed path, hashed words, length, link share, place."""
    x = np.zeros((len(found), PATH + WORDS + NUMBERS), np.float32)
    known = _hashes.get
    for k, b in enumerate(found):
        for depth, part in enumerate(b.path):
            x[k, xxhash.xxh32_intdigest(part) % PATH] = 1.0
        words = b.text.lower().split()
        place = [known(w) for w in words]
        if None in place:
            place = [hash_word(w) if h is None else h for w, h in zip(words, place)]
        count = np.bincount(place, minlength=WORDS)
        x[k, PATH:PATH + WORDS] = count / np.sqrt((count * count).sum() + 1e-9)
        x[k, PATH + WORDS:] = (np.log1p(len(words)) / 4, b.linked, k / max(1, len(found) - 1), b.text.endswith((".", "!", "?")))
    return x


_hashes: dict[str, int] = {}


def hash_word(w: str) -> int:
    out = _hashes.get(w)
    if out is None:
        out = xxhash.xxh32_intdigest(w) % WORDS
        if len(_hashes) < 300_000:
            _hashes[w] = out
    return out


def _teacher(path: tuple[str, ...]) -> int | None:
    """1 main text, 0 not, by what tags and names mean."""
    if any(p in OTHER_TAGS or p[1:] in OTHER_MARKS for p in path):
        return 0
    if any(p in MAIN or (p[:1] == "." and p[1:] in CONTENT_MARKS) for p in path):
        return 1
    return 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output per step."""

    def __init__(self, seed: int = 3):
        rng = np.random.RandomState(seed)
        n = PATH + WORDS + NUMBERS
        draw = lambda *s: (rng.randn(*s) / np.sqrt(s[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p |= {f"w{d}": draw(n, 4 * HIDDEN), f"u{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN:2 * HIDDEN] = 1
        self.p |= {"o": draw(2 * HIDDEN, 1), "k": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; x is (steps, pages, inputs), mask (steps, pages, 1)."""
        p, (t, n, _) = self.p, x.shape
        z = x @ p[f"w{d}"] + p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((t, n, HIDDEN), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[s] + h @ p[f"u{d}"]
            gates = _sigmoid(a[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(a[:, 3 * HIDDEN:])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[s]
            h2 = o * tc
            if keep is not None:
                keep.append((s, i, f, o, g, c, tc, h, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[s] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run(x, mask, "f"), self._run(x, mask, "b")), 2)
        return _sigmoid(both @ self.p["o"] + self.p["k"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by back-propagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate((states["f"], states["b"]), 2)
        q = _sigmoid(both @ self.p["o"] + self.p["k"])
        n = mask.sum()
        e = np.where(mask, q - y[:, :, None], 0).astype(np.float32) / n
        loss = float(-np.where(mask[:, :, 0], np.log(np.where(y > 0.5, q[:, :, 0], 1 - q[:, :, 0]) + 1e-9), 0).sum() / n)
        grad = {"o": np.tensordot(both, e, ((0, 1), (0, 1))), "k": e.sum((0, 1))}
        back = e @ self.p["o"].T
        for d, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p[f"u{d}"])
            dh, dc = np.zeros(part.shape[1:], np.float32), np.zeros(part.shape[1:], np.float32)
            for s, i, f, o, g, c, tc, h, m in reversed(kept[d]):
                dh = dh + part[s]
                on, skip = np.where(m, dh, 0), np.where(m, 0, dh)
                dcc = np.where(m, dc, 0) + on * o * (1 - tc * tc)
                a = np.concatenate((dcc * g * i * (1 - i), dcc * c * f * (1 - f), on * tc * o * (1 - o), dcc * i * (1 - g * g)), 1)
                dz[s] = a
                du += h.T @ a
                dh, dc = a @ self.p[f"u{d}"].T + skip, dcc * f + np.where(m, 0, dc)
            grad |= {f"w{d}": np.tensordot(x, dz, ((0, 1), (0, 1))), f"u{d}": du, f"c{d}": dz.sum((0, 1))}
        return loss, grad


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in pages)
    x = np.zeros((t, len(pages), PATH + WORDS + NUMBERS), np.float32)
    mask = np.zeros((t, len(pages), 1), bool)
    for k, v in enumerate(pages):
        x[:len(v), k], mask[:len(v), k] = v, True
    return x, mask


def _varied(found: list[Block], rng: random.Random) -> list[Block]:
    """The page with other names for its containers, and with more that is not main text."""
    swap = {"article": rng.choice([("article",), ("main",), ("main", "article"), ("div", "." + rng.choice(CONTENT_MARKS)), ("section", "." + rng.choice(CONTENT_MARKS)), ("article", "." + rng.choice(CONTENT_MARKS))])}
    # a container that only its place and text tell apart stays as it is: the teacher needs a name
    out = [Block(b.text, tuple(y for x in b.path for y in swap.get(x, (x,))), b.linked) for b in found]
    words = [w for b in found for w in b.text.split()] or ["x"]
    for _ in range(rng.randint(0, 5)):
        over = rng.choice([("aside",), ("header",), ("nav", "ul", "li", "a"), ("form", "label"), ("footer", "p"), ("div", "." + rng.choice(sorted(OTHER_MARKS))),
                           ("section", "." + rng.choice(sorted(OTHER_MARKS)), "p"), ("div", "." + rng.choice(sorted(OTHER_MARKS)), "ul", "li", "a")])
        start, linked = rng.randrange(len(words)), 1.0 if over[-1] == "a" else 0.0
        place = rng.choice([0, len(out), rng.randint(0, len(out))])
        within = tuple(x for x in out[place].path if x in ("html", "body", *MAIN)) if place < len(out) else ("html", "body")
        for _ in range(rng.randint(1, 6)):
            start = rng.randrange(len(words))
            out.insert(place, Block(" ".join(words[start:start + rng.choice([1, 2, 4, 12, 40])]), (*within, *over), linked))
    return out


def train(pages: list[str | None], steps: int = 160, seed: int = 3) -> Labeller:
    """A labeller from sampled pages; each step takes 24 of them, varied anew."""
    net, rng = Labeller(seed), random.Random(seed)
    sample = [b for b in map(blocks, pages) if b]
    if not sample:
        return net
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t in range(1, steps + 1):
        chosen = [_varied(rng.choice(sample), rng) for _ in range(24)]
        x, mask = _batch([features(b) for b in chosen])
        y = np.zeros(mask.shape[:2], np.float32)
        for k, b in enumerate(chosen):
            y[:len(b), k] = [_teacher(v.path) for v in b]
        _, grad = net.gradients(x, mask, y)
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - 0.03 * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.99 ** t)) + 1e-6)).astype(np.float32)
    return net


def label(net: Labeller, pages: list[list[Block]]) -> list[list[bool]]:
    """Which blocks of each page are main text; pages of similar length run together."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= CELLS and stop - at < 512:
            stop += 1
        some = order[at:stop]
        x, mask = _batch([features(pages[k]) for k in some])
        q = net.probabilities(x, mask)
        for j, k in enumerate(some):
            out[k] = (q[:len(pages[k]), j] >= 0.5).tolist()
        at = stop
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """A labeller from about ``sample`` pages."""
    some = bounded_sample(pages.select(F.col(id_col), F.col(html_col).cast("string").alias("_h")), id_col, sample)
    return train([r._h for r in some.orderBy(id_col).limit(2 * sample).collect()])


def extract(pages: DataFrame, net: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_html"))
    sent = pages.sparkSession.sparkContext.broadcast(net)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                found = [blocks(h) for h in b.column(2).to_pylist()]
                texts = [" ".join(x.text for x, on in zip(p, keep) if on) for p, keep in zip(found, label(sent.value, found))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[id_col, url_col, "text", "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2]]
    return rows.mapInArrow(run, ", ".join(kinds) + ", text string, n_chars long")
