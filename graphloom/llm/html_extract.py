"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks.  A block is a vector of its tag path (hashed tags, classes and ids), its
hashed words and a few measures.  A bidirectional LSTM in numpy reads the whole sequence, so every block is
judged with the context of the whole document, and the blocks judged as article are joined.

No page is labelled, so the labels are made: a bounded sample of pages (at most ``SAMPLE`` of at most ``SAMPLE_BYTES`` each,
lowest id hashes) is labelled by what the markup says of itself, and its blocks are also set anew into page layouts of
many kinds with known labels.  There parts bear known names, made-up names or none, and the tags may say
nothing, so the network learns to judge by text, links, places and like neighbours too.  All blocks of the sample teach; long
pages do so in windows of ``WINDOW`` blocks.

A page's memory is its blocks and one stretch of their vectors: short pages share a bounded batch, a long one is read in
stretches with the state of the network carried from each to the next.

Defined results: null html gives an empty text; a page without article blocks too; markup that is broken or cut is read as
far as it goes; repeated rows are extracted alike; an empty table gives an empty result; other columns are kept, but for
one called ``text``, which the result replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.html_blocks import Block, Path, blocks_of
from graphloom.llm.scratch import numbered, other_columns

SAMPLE, SAMPLE_BYTES, WINDOW = 240, 400_000, 120
PATH, WORDS, MEASURES, HIDDEN = 128, 32, 11, 32
#: Pages parsed together, and their characters; blocks, padding included, that go through the network together.
BATCH, BYTES, STEPS = 256, 4_000_000, 16_384
LAYOUTS, EPOCHS = 20, 9  # random layouts of each sample page, passes over all of them

#: What markup calls the parts of a page (fixed values).
ARTICLE_TAGS, OTHER_TAGS = ("article", "main"), ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset", "head")
ARTICLE_NAMES = ("article", "article-body", "content", "entry", "entry-content", "main", "main-content", "post", "post-body", "post-content", "story", "story-body", "text", "body-text", "page-content")
OTHER_NAMES = {
    "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "links", "tabs"),
    "header": ("header", "masthead", "site-header", "logo", "banner", "branding", "top"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "legal", "colophon"),
    "sidebar": ("sidebar", "side", "related", "widget", "recommended", "popular", "trending", "aside", "rail", "more"),
    "notice": ("notice", "cookie", "cookies", "cookie-notice", "consent", "alert", "gdpr", "popup", "modal", "message", "warning"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adbox", "ad-slot"),
    "form": ("form", "search", "subscribe", "newsletter", "signup", "login", "contact"),
    "comments": ("comment", "comments", "replies", "reply", "discussion", "responses", "disqus", "reader-comments"),
    "share": ("share", "social", "tags", "meta", "byline", "author-box", "pagination"),
}
_OTHER = frozenset(n for names in OTHER_NAMES.values() for n in names)


def markup_labels(blocks: Sequence[Block]) -> list[int]:
    """1 for blocks whose path names an article and nothing beside it, as the markup says itself."""
    said: dict[int, tuple[bool, bool]] = {0: (False, False)}  # of each path: an article, something else
    for path in _paths(blocks):
        tag, *named = path.step.split()
        names = {w[1:] for w in named}
        article, other = said[path.parent.number]
        said[path.number] = (article or tag in ARTICLE_TAGS or not names.isdisjoint(ARTICLE_NAMES), other or tag in OTHER_TAGS or not names.isdisjoint(_OTHER))
    return [int(said[b.path.number] == (True, False)) for b in blocks]


def _paths(blocks: Sequence[Block]) -> list[Path]:
    """All paths of the blocks and those above them, each after its parent."""
    found: dict[int, Path] = {}
    for b in blocks:
        at = b.path
        while at.parent is not None and at.number not in found:
            found[at.number] = at
            at = at.parent
    return [found[n] for n in sorted(found)]  # a path is numbered after its parent


@lru_cache(maxsize=20_000)
def _hashed(step: str, own: str) -> tuple[tuple[int, int], ...]:
    """Places and signs of the words of a step; those of a block's own element count apart."""
    hashes = [crc32((own + part.lstrip(".#")).encode()) for word in step.split() for part in {word, *re.split(r"[-_]", word)}]
    return tuple((h % PATH, 1 if h & (1 << 20) else -1) for h in hashes)


class PageRows:
    """The vectors of a page's blocks, made for any stretch of them."""

    def __init__(self, blocks: Sequence[Block]) -> None:
        self.blocks = blocks
        # How much text, and how much of it in links, the blocks under the same parent and the same grandparent hold.
        self.held: dict[tuple[int, int], list[int]] = {}
        self.whole = max(1, sum(len(b.text) for b in blocks))
        for b in blocks:
            for key in self._keys(b.path):
                held = self.held.setdefault(key, [0, 0])
                held[0] += len(b.text)
                held[1] += b.link_chars
        self.own = {b.path.number: i for i, b in enumerate({b.path.number: b for b in blocks}.values())}
        self.vectors = np.zeros((len(self.own), PATH), dtype=np.float32)
        self._walk(_paths(blocks))

    @staticmethod
    def _keys(path: Path) -> tuple[tuple[int, int], tuple[int, int]]:
        """Numbers of the parent and the grandparent; the outermost has itself."""
        above = path.parent or path
        higher = above.parent or above
        return (1, above.number), (1 if above.parent or not path.parent else 2, higher.number)

    def _walk(self, paths: list[Path]) -> None:
        """Path vectors, each from its parent's; one that no later path needs is dropped."""
        left: dict[int, int] = {}
        for path in paths:
            left[path.parent.number] = left.get(path.parent.number, 0) + 1
        above = {0: np.zeros(PATH, dtype=np.float32)}
        for path in paths:
            base = above[path.parent.number]
            left[path.parent.number] -= 1
            if not left[path.parent.number]:
                del above[path.parent.number]
            if path.number in self.own:
                row = self.vectors[self.own[path.number]]
                row += base
                for place, sign in _hashed(path.step, "own "):
                    row[place] += sign
            if left.get(path.number):
                base = base.copy()
                for place, sign in _hashed(path.step, ""):
                    base[place] += sign
                above[path.number] = base

    def rows(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """A row for each block from ``low`` to before ``high``."""
        blocks = self.blocks[low:high]
        x = np.zeros((len(blocks), PATH + WORDS + MEASURES), dtype=np.float32)
        for i, b in enumerate(blocks):
            words = b.text.split()
            x[i, :PATH] = self.vectors[self.own[b.path.number]]
            x[i, PATH : PATH + WORDS] = np.bincount([crc32(w.encode()) % WORDS for w in words], minlength=WORDS) / np.sqrt(len(words))
            n, shares = len(b.text), []
            for key in self._keys(b.path):
                chars, links = self.held[key]
                shares += [chars / self.whole, links / chars]
            x[i, PATH + WORDS :] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1.0, b.link_chars / n), (b.text.count(".") + b.text.count(",")) / len(words), b.text[-1] in ".!?", (low + i) / len(self.blocks), np.log1p(len(self.blocks)) / 4, *shares)
        return x


def page_matrix(blocks: Sequence[Block]) -> np.ndarray:
    """A row for each block."""
    return PageRows(blocks).rows()


Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first ``lengths`` steps in reverse order; its own inverse."""
    t = np.arange(x.shape[1])
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def _run(p: Params, side: str, x: np.ndarray, trace: list | None = None, state: list[np.ndarray] | None = None) -> np.ndarray:
    """Hidden states of one direction; ``state`` (h, c) goes on from an earlier stretch and is updated."""
    rows, steps, _ = x.shape
    inputs = x @ p[f"{side}x"] + p[f"{side}b"]
    h, c = state or (np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32))
    out = np.empty((rows, steps, HIDDEN), np.float32)
    for t in range(steps):
        z = inputs[:, t] + h @ p[f"{side}h"]
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        keep, write, show = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        if trace is not None:
            trace.append((h, c, keep, write, show, new))
        c = keep * c + write * new
        h = show * np.tanh(c)
        out[:, t] = h
        if trace is not None:
            trace[-1] += (c,)
    if state is not None:
        state[:] = h, c
    return out


def _back(p: Params, side: str, x: np.ndarray, trace: list, d_out: np.ndarray, grads: Params) -> None:
    rows, steps, _ = x.shape
    d_z = np.empty((rows, steps, 4 * HIDDEN), np.float32)
    d_h, d_c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, keep, write, show, new, c_next = trace[t]
        d_h = d_h + d_out[:, t]
        th = np.tanh(c_next)
        d_c = d_c + d_h * show * (1 - th * th)
        d_z[:, t] = np.concatenate([d_c * c * keep * (1 - keep), d_c * new * write * (1 - write), d_h * th * show * (1 - show), d_c * write * (1 - new * new)], axis=1)
        grads[f"{side}h"] += h.T @ d_z[:, t]
        d_h, d_c = d_z[:, t] @ p[f"{side}h"].T, d_c * keep
    grads[f"{side}x"] += np.einsum("btd,btg->dg", x, d_z, optimize=True)
    grads[f"{side}b"] += d_z.sum(axis=(0, 1))


def logits(p: Params, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For every block of every (padded) page."""
    ahead, behind = _run(p, "f", x), _turned(_run(p, "r", _turned(x, lengths)), lengths)
    return np.concatenate([ahead, behind], axis=2) @ p["o"] + p["ob"]


def _pad(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray([len(m) for m in pages])
    x = np.zeros((len(pages), int(lengths.max()), PATH + WORDS + MEASURES), dtype=np.float32)
    for row, m in zip(x, pages, strict=True):
        row[: len(m)] = m
    return x, lengths


def fit(pages: Sequence[tuple[np.ndarray, np.ndarray]], *, epochs: int = EPOCHS, rate: float = 6e-3, seed: int = 9) -> Params:
    """Train on (matrix, labels) pages by Adam over shuffled batches."""
    rng, width = np.random.default_rng(seed), PATH + WORDS + MEASURES
    p: Params = {"o": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "ob": np.zeros(1, np.float32)}
    for side in "fr":
        p[f"{side}x"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN)).astype(np.float32)
        p[f"{side}h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"{side}b"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]) + rng.random() * 8)
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        for k in rng.permutation(len(batches)):
            chosen = [pages[i] for i in batches[k]]
            x, lengths = _pad([page for page, _ in chosen])
            y, _ = _pad([np.pad(label[:, None], ((0, 0), (0, width - 1))) for _, label in chosen])
            mask = (np.arange(x.shape[1]) < lengths[:, None]).astype(np.float32)
            forth, back, turned = [], [], _turned(x, lengths)
            states = np.concatenate([_run(p, "f", x, forth), _turned(_run(p, "r", turned, back), lengths)], axis=2)
            error = (_sigmoid(states @ p["o"] + p["ob"]) - y[:, :, 0]) * mask / mask.sum()
            grads = {name: np.zeros_like(a) for name, a in p.items()}
            grads["o"], grads["ob"] = np.einsum("bt,bth->h", error, states), error.sum(keepdims=True)[0]
            d_states = error[:, :, None] * p["o"]
            _back(p, "f", x, forth, d_states[:, :, :HIDDEN], grads)
            _back(p, "r", turned, back, _turned(d_states[:, :, HIDDEN:], lengths), grads)
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lr = rate * (1 - epoch / (epochs + 1))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                p[name] = p[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return p


def layout(article: Sequence[str], other: Sequence[str], rng: np.random.Generator) -> str:
    """A page of a random layout: the article's blocks under one wrapper, parts of other kinds around it."""
    pick = lambda names: names[int(rng.integers(len(names)))]
    made_up = {}  # a page without telling names calls each kind of part by a word of its own, or not at all
    mute, plain_tags = rng.random() < 0.35, rng.random() < 0.4

    def name_of(kind: str, names: Sequence[str]) -> str:
        if not mute:
            return pick(names)
        word = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 7))))
        return made_up.setdefault(kind, word if rng.random() < 0.7 else "")

    said = lambda: pick(other) if other else "More"
    attribute = lambda name: f' {pick(("class", "id"))}="{name}"' if name else ""

    def part(kind: str) -> str:
        names, tags = OTHER_NAMES[kind], {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div"), "form": ("form", "div"), "comments": ("section", "div", "ul")}
        tag = "div" if plain_tags else pick(tags.get(kind, ("div", "section", "p")))
        named = attribute(name_of(kind, names)) if tag in ("div", "section", "p", "ul") or rng.random() < 0.5 else ""
        text = lambda: pick(article) if article and kind in ("comments", "sidebar", "advert", "notice") and rng.random() < 0.4 else said()
        many = int(rng.integers(1, 6)) if kind in ("menu", "sidebar", "comments", "footer") else int(rng.integers(1, 3))
        if kind in ("menu", "sidebar", "share") and rng.random() < 0.7:
            inner = "".join(f'<li><a href="/">{text()[:40]}</a></li>' for _ in range(many))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{said()[:30]}</label><input><button>{said()[:12]}</button>"
        elif tag == "p":
            inner = said()
        else:
            inner = "".join(f"<{w}>{text()}</{w}>" for w in (pick(("p", "div", "span")) for _ in range(many)))
        return f'<{tag}{named} data-label="0">{inner}</{tag}>'

    inside = [pick(("p", "p", "p", "div", "li", "blockquote", "h2")) for _ in article]
    lines = [f"<{t}>{text}</{t}>" if rng.random() < 0.9 else f"<{t}>{text}" for t, text in zip(inside, article, strict=True)]
    if lines and rng.random() < 0.7:
        lines[0] = f"<h1>{article[0]}</h1>"
    for kind in ("advert", "share", "comments", "notice"):
        if len(lines) > 2 and rng.random() < 0.12:
            lines.insert(int(rng.integers(1, len(lines))), part(kind))
    wrapper = "div" if plain_tags else pick(("article", "main", "div", "div", "section"))
    name = attribute(name_of("article", ARTICLE_NAMES)) if wrapper in ("div", "section") or rng.random() < 0.3 else ""
    body = f'<{wrapper}{name} data-label="1">{"".join(lines)}</{wrapper}>'
    if rng.random() < 0.3:
        body = f"<div{attribute(pick(('container', 'page', 'wrap', 'row', '')))}>{body}</div>"
    before = [part(k) for k in ("header", "menu", "notice", "advert", "form", "share", "sidebar") if rng.random() < 0.45]
    after = [part(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.45]
    return f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def train(pages: Sequence[str], *, seed: int = 21) -> Params:
    """The network for a sample of raw pages."""
    rng, examples, texts, others = np.random.default_rng(seed), [], [], []
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")

    def add(blocks: list[Block]) -> None:
        x, y = page_matrix(blocks), np.asarray([b.label for b in blocks], dtype=np.float32)
        examples.extend((x[at : at + WINDOW], y[at : at + WINDOW]) for at in range(0, len(blocks), WINDOW))

    for page in pages:
        blocks = blocks_of(page)
        labels = iter(markup_labels(blocks))
        for b in blocks:
            b.label = next(labels)
        texts.append([escape(b.text) for b in blocks if b.label])
        others += [escape(b.text) for b in blocks if not b.label]
        add(blocks)
    others = others or ["Home", "About us", "Contact"]
    for article in texts:
        for _ in range(LAYOUTS):
            blocks = blocks_of(layout(article, others, rng)) if article else []
            for b in blocks:
                b.label = int(bool(b.label))
            add(blocks)
    return fit(examples) if examples else fit([(np.zeros((1, PATH + WORDS + MEASURES), np.float32), np.zeros(1, np.float32))], epochs=1)


def long_scores(p: Params, blocks: Sequence[Block]) -> np.ndarray:
    """Scores of a page of any length, read in stretches of ``STEPS`` blocks with the state carried on, once from each end."""
    page, scores = PageRows(blocks), np.full(len(blocks), p["ob"][0], dtype=np.float32)
    for side, weights in (("f", p["o"][:HIDDEN]), ("r", p["o"][HIDDEN:])):
        state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
        lows = range(0, len(blocks), STEPS)
        for low in lows if side == "f" else reversed(lows):
            x = page.rows(low, low + STEPS)
            turn = slice(None, None, 1 if side == "f" else -1)
            scores[low : low + STEPS] += (_run(p, side, x[None, turn], state=state)[0] @ weights)[turn]
    return scores


def main_texts(p: Params, pages: Sequence[str]) -> list[str]:
    """The article text of each page.  Pages of like length go through the network together, ``STEPS`` padded blocks at most."""
    parsed = [blocks_of(page) for page in pages]
    texts = [""] * len(pages)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        last = at + 1
        while last < len(order) and last - at < 64 and (last - at + 1) * len(parsed[order[last]]) <= STEPS:
            last += 1
        rows = order[at:last]
        if len(parsed[rows[0]]) > STEPS:
            results = [long_scores(p, parsed[rows[0]])]
        else:
            results = logits(p, *_pad([page_matrix(parsed[i]) for i in rows]))
        for i, scores in zip(rows, results, strict=True):
            texts[i] = " ".join(b.text for b, s in zip(parsed[i], scores, strict=False) if s > 0)
        at = last
    return texts


def _shares_of(pages: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Runs of at most ``BATCH`` pages of about ``BYTES`` characters together."""
    first = held = 0
    for i, page in enumerate(pages):
        if i > first and (i - first >= BATCH or held + len(page) > BYTES):
            yield first, i
            first, held = i, 0
        held += len(page)
    if first < len(pages):
        yield first, len(pages)


def extract_main_text(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (the article, blocks joined by a space)."""
    taught = pages.where(F.octet_length(html) <= SAMPLE_BYTES).select(page_id, html)
    # Pages are drawn by hash first, with a margin, so that tasks pass on only about ``SAMPLE`` pages together.
    draw = F.pmod(F.xxhash64(page_id), F.lit(1 << 40))
    share = min(1.0, 1.5 * SAMPLE / max(taught.count(), 1))
    chosen = taught.where(draw <= int(share * (1 << 40))).orderBy(draw, page_id).limit(SAMPLE)
    model = pages.sparkSession.sparkContext.broadcast(train([r[1] for r in sorted(chosen.collect(), key=lambda r: (str(r[0]), r[1]))]))
    own = other_columns(pages, html, "text")
    schema = T.StructType([*[pages.schema[c] for c in own], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [h or "" for h in batch.column(len(own)).to_pylist()]
            for first, last in _shares_of(whole):
                part = batch.slice(first, last - first)
                texts = main_texts(model.value, whole[first:last])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(texts, pa.string())], names=[*own, "text"])

    return numbered(pages, [*own, html]).mapInArrow(run, schema)
