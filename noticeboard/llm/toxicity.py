"""Toxicity scores: bags of hashed character n-grams, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its n-grams (with boundary marks), a passage of consecutive words is the average of its words' vectors, and a
softmax over the passage says how toxic it is.  A document is as toxic as its worst passage, so a short insult is not averaged away by
a long text.  Misspellings share most n-grams with the word they spoil, and so its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTE_VALUES, LOWER, Spans, Texts, U, mix, pieces, ranges, unused

SIZES = (3, 4, 5, 6, 7)  # bytes of an n-gram, boundary marks included
BUCKETS = 1 << 17
DIM = 8
PASSAGE = 24  # words; passages overlap by half


class Bags:
    """Words of some texts, each distinct word once, with the bucket numbers of its n-grams."""

    def __init__(self, texts: Texts, buckets: int = BUCKETS):
        # one space before, between and after all words serves as their boundary mark
        words = texts.words(lower=True)
        self.first = words.first
        _, at, word = np.unique(words.hash, return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        start, size = words.start[at], (words.end - words.start)[at]
        padded = size + 2
        self.offsets = np.concatenate([[0], np.cumsum(padded)])
        flat = np.full(int(self.offsets[-1]), 0x20, np.uint8)
        inner = np.ones(len(flat), bool)
        inner[self.offsets[:-1]] = inner[self.offsets[1:] - 1] = False
        flat[inner] = LOWER[texts.buffer[ranges(start, size)]]
        owner = np.repeat(np.arange(len(at)), padded)
        spans, grams, owners = Spans(BYTE_VALUES[flat]), [], []
        left = self.offsets[owner + 1] - np.arange(len(flat))  # bytes to the end of the word
        for n in SIZES:
            s = np.flatnonzero(left >= n)
            grams.append((spans.hash(s, s + n) % U(buckets)).astype(np.int32))
            owners.append(owner[s])
        grams.append((mix(words.hash[at]) % U(buckets)).astype(np.int32))  # the word itself
        owners.append(np.arange(len(at)))
        grams, owners = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        # a word repeated within half a passage counts once there
        half = PASSAGE // 2
        text = words.text_of()
        block = (np.arange(len(self.word)) - words.first[text]) // half
        by = np.lexsort((np.arange(len(self.word)), self.word, block, text))
        same = (self.word[by][1:] == self.word[by][:-1]) & (block[by][1:] == block[by][:-1]) & (text[by][1:] == text[by][:-1])
        self.fresh = np.ones(len(self.word), bool)
        self.fresh[by[1:][same]] = False
        self.grams, self.gram_at = grams[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(at)))])

    def word_means(self, weights: np.ndarray) -> np.ndarray:
        """Mean of a weight per bucket over the n-grams of every distinct word."""
        if not len(self.grams):
            return np.zeros(0)
        return np.add.reduceat(weights[self.grams], self.gram_at[:-1]) / np.diff(self.gram_at)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Running sums over the words of all texts."""
        return np.concatenate([[0.0], np.cumsum(self.word_means(weights)[self.word] * self.fresh)])


def passages(first: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of the passages; every text with words has at least one."""
    half, count = size // 2, np.diff(first)
    number = np.where(count > 0, np.maximum(1, -(-(count - half) // half)), 0)
    text = np.repeat(np.arange(len(count)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin = first[text] + k * half
    return text, begin, np.minimum(begin + size, first[text + 1])


@dataclass
class Model:
    margin: np.ndarray  # per bucket: its vector times the difference of the softmax columns
    bias: float

    def logits(self, texts: Texts) -> np.ndarray:
        """Per text; texts without words get the bias alone."""
        bags = Bags(texts, len(self.margin))
        values = bags.sums(self.margin)
        text, a, z = passages(bags.first)
        out = np.full(len(texts), self.bias)
        if len(text):
            at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[at]] = np.maximum.reduceat((values[z] - values[a]) / PASSAGE, at) + self.bias
        return out


def train(rows: pa.RecordBatch, labels: np.ndarray, epochs: int = 10, refine: int = 4, rate: float = 2.0, each: int = 4, gain: float = 5.0, buckets: int = BUCKETS, dim: int = DIM, seed: int = 7) -> Model:
    """Fits vectors and softmax together by stochastic gradient steps (Adagrad).

    rows: a column text; labels: 0 or 1.  At first any passages carry their document's label, `each` per document on average, so that
    only what toxic documents share is learned; in the last `refine` epochs a toxic document teaches by its worst passage alone, and
    a clean one by its worst and any others.  Without both labels the scores are constant.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (buckets, dim)).astype(np.float32) / dim
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    labels = np.asarray(labels, np.int64)
    base = float(np.clip(labels.mean() if len(labels) else 0.0, 0.001, 0.999))
    bias = np.array([0, np.log(base / (1 - base))], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(buckets, np.float32), float(bias[1]))
    parts, at = [], 0
    for part in pieces(iter([rows]), most=1 << 16):
        parts.append((Bags(part, buckets), labels[at : at + len(part)]))
        at += len(part)
    hist_v, hist_s, hist_b = np.full(buckets, 1e-6, np.float32), np.full_like(soft, 1e-6), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(parts)):
            bags, want = parts[i]
            values = bags.sums(vectors @ (soft[:, 1] - soft[:, 0]))
            text, a, z = passages(bags.first)
            if not len(text):
                continue
            if epoch < epochs - refine:
                chosen = rng.choice(len(text), min(len(text), each * len(want)), replace=False)
            else:
                order = np.lexsort((values[z] - values[a], text))
                worst = order[np.concatenate([text[order][1:] != text[order][:-1], [True]])]
                tame = np.flatnonzero(want[text] == 0)
                chosen = np.concatenate([worst, rng.choice(tame, min(len(tame), each * len(want)), replace=False)])
            at = ranges(a[chosen], z[chosen] - a[chosen])
            owner = np.repeat(np.arange(len(chosen)), z[chosen] - a[chosen])[bags.fresh[at]]
            word = bags.word[at[bags.fresh[at]]]
            size = np.diff(bags.gram_at)[word]
            flat, owner = bags.grams[ranges(bags.gram_at[word], size)], np.repeat(owner, size)
            coef = np.repeat(1 / (PASSAGE * size), size).astype(np.float32)
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            mean = np.add.reduceat(vectors[flat] * coef[:, None], cuts)
            raw = mean @ soft + bias
            prob = np.exp(raw - raw.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(chosen)), want[text[chosen]]] -= 1
            error = prob * np.where((want[text[chosen]] == 1) & (epoch >= epochs - refine), gain, 1)[:, None] / len(want)
            g_soft, g_bias, g_mean = mean.T @ error, error.sum(0), error @ soft.T
            hist_s += g_soft**2
            hist_b += g_bias**2
            soft -= step * g_soft / np.sqrt(hist_s)
            bias -= step * g_bias / np.sqrt(hist_b)
            used, inverse = np.unique(flat, return_inverse=True)
            g_vec = np.stack([np.bincount(inverse, coef * g_mean[owner, d], len(used)) for d in range(dim)], 1).astype(np.float32)
            hist_v[used] += (g_vec**2).mean(1)
            vectors[used] -= step * g_vec / np.sqrt(hist_v[used])[:, None]
    return Model((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, most: int = 4000, most_chars: int = 20_000, part: int = 1, parts: int = 3) -> DataFrame:
    """A bounded, repeatable sample (doc_id, text, toxic) of labelled rows whose crc32(doc_id) modulo parts is not part: at most `most`
    documents of at most `most_chars` characters, in the order of a hash of the id.  Null labels and ids are no labels; of repeated labels
    the largest counts.
    """
    rule = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) != part
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & rule).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= most_chars)).select("doc_id", "text")
    return texts.join(chosen, "doc_id").select("doc_id", F.col("text").cast("string").alias("text"), F.col("_toxic").cast("int").alias("toxic"))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, column: str = "_score") -> DataFrame:
    """The columns `keep` of docs (all if None) and the score (0 to 1) of every whole text, in a column named `column`, with underscores
    where a kept column has that name.

    Null and empty texts get the score of a text without words.  Repeated rows get the same score each.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: one float per bucket
    rows = docs.select(F.col("text").cast("string").alias(unused("_whole", docs)), *[F.col(c) for c in keep])
    out = docs.select(*keep).schema.add(unused(column, docs.select(*keep)), "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches, 0):
            values = 1 / (1 + np.exp(-shared.value.logits(texts).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*texts.rows.columns[1:], pa.array(values)], names=out.names)

    return rows.mapInArrow(run, out)


def fitted(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out third.  One task fits it; the driver gets the model alone."""
    rows = sample(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for batch in batches:
            got = pa.Table.from_batches([batch]) if got is None else pa.concat_tables([got, pa.Table.from_batches([batch])])
            if got.num_rows > 4 * most:  # repeated document ids cannot make it larger than this
                got = _first(got, 2 * most)
        if got is None or not got.num_rows:
            return
        got = _first(got, 2 * most)
        model = train(got.to_batches()[0], got["toxic"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.margin.tobytes()], pa.binary()), pa.array([float(model.bias)])], names=["margin", "bias"])

    found = rows.repartition(1).mapInArrow(run, "margin binary, bias double").first()
    if found is None:
        return train(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), np.zeros(0, np.int64))
    return Model(np.frombuffer(found["margin"], np.float32), found["bias"])


def _first(rows: pa.Table, n: int) -> pa.Table:
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).slice(0, n).combine_chunks()
