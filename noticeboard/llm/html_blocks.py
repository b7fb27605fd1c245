"""Main text of web pages by a recurrent block labeller.

A page is read as its leaf sequence: runs of text between block-level tags, each with the path of elements above it.  Every block
becomes a vector of its hashed path (tags, words of class, id and role), its hashed words and its shape; a bidirectional LSTM in numpy
reads the whole sequence, so that a block is classified in the context of the page.  The labeller is trained on pages put together by
rule: blocks of a bounded sample of the given pages in containers whose meaning is known.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: elements that end a run of text, elements without content, and elements whose content is no text of the page
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul button iframe noscript script style svg object canvas audio video".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("head script style template noscript svg object canvas audio video iframe title select textarea option button".split())
#: an opening tag that ends an open one of the same group
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# fixed values: what containers are called where the article is, and where it is not
MAIN_NAMES = "article content entry post story body text main page-content article-body post-content entry-content main-content blog-post news-text".split()
OTHER_NAMES = (
    "nav menu navbar navigation breadcrumb breadcrumbs sidebar side widget related recommended ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent notice alert "
    "popup modal overlay newsletter subscribe signup share sharing social comments comment comment-list replies reply discussion disqus login search footer copyright header masthead topbar "
    "site-header site-footer pagination pager tags toolbar skip teaser links legal disclaimer"
).split()
OTHER_TAGS = ["nav", "header", "footer", "aside", "form"]
ROLES = {"navigation": "nav", "banner": "div", "contentinfo": "div", "complementary": "div", "search": "div"}

#: words of attributes that the made pages have; any other has no learned weight, and its bucket would lend it that of some name here
LEARNED = frozenset(f".{w}" for name in (*MAIN_NAMES, *OTHER_NAMES, *ROLES) for w in name.split("-"))

PATH, WORDS, SHAPE = 192, 32, 8
WIDTH = PATH + WORDS + SHAPE
HIDDEN = 24


@dataclass
class Block:
    path: tuple[str, ...]  # what stands above it, outermost first
    text: str
    linked: int  # characters inside links


class _Leaves(HTMLParser):
    """Blocks of one page, for markup of any quality."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._open: list[tuple[str, tuple[str, ...]]] = []
        self._run: list[str] = []
        self._linked = 0
        self._silent = 0
        self._links = 0

    def _end_run(self) -> None:
        text = " ".join("".join(self._run).split())
        if text:
            self.blocks.append(Block(tuple(name for _, names in self._open for name in names), text, self._linked))
        self._run, self._linked = [], 0

    def _pop(self, depth: int) -> None:
        for tag, _ in self._open[depth:]:
            self._silent -= tag in SILENT_TAGS
            self._links -= tag == "a"
        del self._open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS:
            self._end_run()
            ends = ENDED_BY.get(tag, set())
            for depth in range(len(self._open) - 1, -1, -1):
                above = self._open[depth][0]
                if above in ends or (above == "p" and tag not in ("button", "svg", "object", "script", "style")):
                    self._pop(depth)
                    break
                if above in ("article", "section", "div", "main", "body", "table", "ul", "ol", "dl", "td", "aside", "nav", "header", "footer"):
                    break
        elif tag == "br":
            self._run.append(" ")
        if tag == "body" and any(t == "head" for t, _ in self._open):
            self._pop(next(i for i, (t, _) in enumerate(self._open) if t == "head"))
        if tag in EMPTY_TAGS:
            return
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [f".{w}" for w in dict.fromkeys(re.findall(r"[a-z]+", value.lower()))]  # all words, each once
        self._open.append((tag, tuple(names)))
        self._silent += tag in SILENT_TAGS
        self._links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._end_run()
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                self._pop(depth)
                return
            if tag not in BLOCK_TAGS and self._open[depth][0] in BLOCK_TAGS:
                return  # an inline tag does not end blocks

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self._run.append(data)
            self._linked += len(data) * (self._links > 0)


#: a tag that the end of the page cuts off is no text
UNFINISHED = re.compile(r"</?[a-zA-Z][^<>]*\Z")


def blocks_of(html: str) -> list[Block]:
    reader = _Leaves()
    reader.feed(UNFINISHED.sub("", html))
    reader.close()
    reader._end_run()
    return reader.blocks


@lru_cache(1 << 16)
def _bucket(name: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(name.encode())
    return h % size, 1 - 2 * (h >> 31)


@lru_cache(1 << 16)
def _word(word: str) -> int:
    """The bucket of a word, those of negative sign after all others."""
    k, sign = _bucket(word.lower(), WORDS)
    return k if sign > 0 else WORDS + k


@lru_cache(1 << 12)
def _path_vector(path: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """The hashed names, and the number of elements (names of attributes begin with a point)."""
    out = np.zeros(PATH, np.float32)
    for name in set(path):
        if name[0] == "." and name not in LEARNED:
            continue
        k, sign = _bucket(name, PATH)
        out[k] += sign
    return out, sum(not name.startswith(".") for name in path)


def features(blocks: list[Block]) -> np.ndarray:
    """One vector per block, all of a page in order."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for i, b in enumerate(blocks):
        out[i, :PATH], depth = _path_vector(b.path)
        words = b.text.split()
        count = np.bincount([_word(w) for w in words], minlength=2 * WORDS)
        out[i, PATH : PATH + WORDS] = (count[:WORDS] - count[WORDS:]) / len(words)
        n = len(b.text)
        out[i, PATH + WORDS :] = (
            np.log1p(n) / 5, np.log1p(len(words)) / 4, b.linked / n, sum(map(b.text.count, ".,;:!?")) / len(words) / 2,
            b.text[-1] in ".!?…»\"”", i / max(1, len(blocks) - 1), depth / 8, sum(map(b.text.count, "0123456789")) / n,
        )
    return out


class Labeller:
    """A bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.12, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["b" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)  # forget gates start open

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: steps x pages x WIDTH; the states of one direction, and what the way back needs."""
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, cache = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = x[t] @ self.p["x" + d] + h @ self.p["h" + d] + self.p["b" + d]
            f, i, o = (1 / (1 + np.exp(-gates[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                cache.append((t, f, i, o, g, c, h, tanh, m))
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            states[t] = h
        return states, cache

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, cf = self._run(x, mask, "f", keep)
        backward, cb = self._run(x, mask, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["out_b"], both, cf, cb

    def learn(self, x: np.ndarray, mask: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        raw, both, cf, cb = self.logits(x, mask, True)
        error = (1 / (1 + np.exp(-raw)) - want) * mask / mask.sum()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["out_b"] = np.einsum("tp,tph->h", error, both), np.array([error.sum()], np.float32)
        for d, cache, part in (("f", cf, slice(0, HIDDEN)), ("b", cb, slice(HIDDEN, None))):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, f, i, o, g, c, h, tanh, m in reversed(cache):
                dh = dh + error[t][:, None] * self.p["out"][part]
                d_out, d_new = dh * m * tanh, dh * m * o * (1 - tanh**2) + dc * m
                gates = np.concatenate([d_new * c * f * (1 - f), d_new * g * i * (1 - i), d_out * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
                grad["x" + d] += x[t].T @ gates
                grad["h" + d] += h.T @ gates
                grad["b" + d] += gates.sum(0)
                dh, dc = gates @ self.p["h" + d].T + dh * (1 - m), d_new * f + dc * (1 - m)
        return grad

    def main(self, pages: list[list[Block]], most: int = 400_000) -> list[np.ndarray]:
        """For every page, which of its blocks are main text; pages of similar length go together, `most` floats at a time."""
        out: list = [np.zeros(0, bool)] * len(pages)
        group: list[int] = []
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        for at, i in enumerate(order):
            group.append(i)
            following = len(pages[order[at + 1]]) if at + 1 < len(order) else None
            if following is None or following * (len(group) + 1) * WIDTH > most:
                x, mask = _batch([features(pages[k]) for k in group])
                raw = self.logits(x, mask)[0]
                for column, k in enumerate(group):
                    out[k] = raw[: len(pages[k]), column] > 0
                group = []
        return out


def _batch(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(v) for v in vectors)
    x, mask = np.zeros((steps, len(vectors), WIDTH), np.float32), np.zeros((steps, len(vectors)), np.float32)
    for k, v in enumerate(vectors):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


def made_page(texts: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page put together by rule from given texts, with the label of every block."""
    blocks: list[Block] = []
    labels: list[int] = []

    def text() -> str:
        return texts[rng.integers(len(texts))]

    def short() -> str:
        words = text().split()
        a = int(rng.integers(max(1, len(words) - 3)))
        return " ".join(words[a : a + int(rng.integers(1, 5))])

    def names(word: str) -> tuple[str, ...]:
        return tuple(f".{w}" for w in word.split("-"))

    def other(above: tuple[str, ...]) -> None:
        kind = rng.integers(4)
        if kind == 0:
            tag = OTHER_TAGS[rng.integers(len(OTHER_TAGS))]
            path = (*above, tag, *(names(OTHER_NAMES[rng.integers(len(OTHER_NAMES))]) if rng.random() < 0.4 else ()))
        elif kind == 1 and rng.random() < 0.4:
            role = list(ROLES)[rng.integers(len(ROLES))]
            path = (*above, ROLES[role], "." + role)
        else:
            path = (*above, ["div", "section", "ul", "p", "div", "aside"][rng.integers(6)], *names(OTHER_NAMES[rng.integers(len(OTHER_NAMES))]))
        listed = rng.random() < 0.4
        for _ in range(int(rng.integers(1, 8))):
            prose = rng.random() < 0.5
            t = text() if prose else short()
            linked = (not prose) and rng.random() < 0.6
            tail = ("ul", "li") if listed else [("p",), (), ("div",), ("div", "p"), ("h3",), ("label",), ("span",)][rng.integers(7)]
            blocks.append(Block((*path, *tail, *(("a",) if linked and rng.random() < 0.5 else ())), t, len(t) if linked else 0))
            labels.append(0)

    body = ("html", "body", *(("div",) if rng.random() < 0.3 else ()))
    for _ in range(int(rng.integers(0, 4))):
        other(body)
    holder = [("article",), ("main",), ("main", "article"), ("div", *names(MAIN_NAMES[rng.integers(len(MAIN_NAMES))])), ("section", *names(MAIN_NAMES[rng.integers(len(MAIN_NAMES))])), ("article", "div", *names(MAIN_NAMES[rng.integers(len(MAIN_NAMES))])), ("div",)][rng.integers(7)]
    many = rng.random() < 0.15
    same = text() if rng.random() < 0.5 else short()  # some articles repeat a line
    repeats = rng.random() < 0.15
    for k in range(int(rng.integers(10, 70) if many else rng.integers(1, 14))):
        heading = (k == 0 and rng.random() < 0.7) or rng.random() < 0.1
        inner = ("h1",) if heading and k == 0 else ("h2",) if heading else [("p",), ("p",), ("p",), ("p", "b"), ("ul", "li"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), (), ("figure", "figcaption")][rng.integers(10)]
        t = same if repeats and not heading and rng.random() < 0.9 else short() if heading or rng.random() < 0.2 else text()
        blocks.append(Block((*body, *holder, *inner), t, 0 if rng.random() < 0.9 else min(len(t), 12)))
        labels.append(1)
        if rng.random() < 0.08:
            other((*body, *holder))  # an advert or a form inside the article
    if rng.random() < 0.3:
        other((*body, *holder))  # comments below it
    for _ in range(int(rng.integers(0, 4))):
        other(body)
    return blocks, labels


def train(sample_pages: list[str], made: int = 2500, epochs: int = 6, batch: int = 25, rate: float = 0.01, seed: int = 3) -> Labeller:
    """A labeller fitted to `made` pages put together from the texts of the sample (from its own words where the sample has none)."""
    rng = np.random.default_rng(seed)
    texts = [b.text for html in sample_pages for b in blocks_of(html) if len(b.text) > 1] or ["Some words of text.", "More words, and others."]
    pages = [made_page(texts, rng) for _ in range(made)]
    vectors = [features(b) for b, _ in pages]
    net = Labeller()
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    order = np.argsort([len(v) for v in vectors], kind="stable")
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _batch([vectors[k] for k in groups[g]])
            want = np.zeros_like(mask)
            for column, k in enumerate(groups[g]):
                want[: len(pages[k][1]), column] = pages[k][1]
            step += 1
            for k, grad in net.learn(x, mask, want).items():  # Adam
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                net.p[k] -= (rate * (1 - 0.8 * epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(pages: DataFrame, most: int = 200, most_chars: int = 50_000) -> list[str]:
    """A bounded, repeatable sample: at most `most` pages of at most `most_chars` characters, in the order of a hash of the id."""
    chosen = pages.where(F.col("html").isNotNull() & (F.length("html") <= most_chars)).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    rows = pages.where(F.length("html") <= most_chars).join(chosen.distinct(), "page_id").select("page_id", "html").limit(most).collect()
    return [r["html"] for r in sorted(rows, key=lambda r: (r["page_id"], r["html"]))]


def extract(pages: DataFrame, labeller: Labeller, rows_at_once: int = 64) -> DataFrame:
    """pages -> page_id, url, text, n_chars, n_blocks (leaf blocks) and n_main (those taken), one row per row.

    The blocks of the main text in page order, white space within a block as one space, joined by one newline.  Null, empty and textless
    pages give an empty text.  Repeated rows get the same text; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # of fixed size
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long").add("n_blocks", "long").add("n_main", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, rows_at_once):
                part = whole.slice(a, rows_at_once)
                found = [blocks_of(html) for html in part.column("html").to_pylist()]
                chosen = shared.value.main(found)
                texts = ["\n".join(b.text for b, yes in zip(blocks, keep) if yes) for blocks, keep in zip(found, chosen)]
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(b) for b in found], pa.int64()), pa.array([int(k.sum()) for k in chosen], pa.int64()),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)
