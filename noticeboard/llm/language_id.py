"""Language identification with string kernels.

A text is the set of its character n-grams of several lengths (a blended spectrum, presence only), hashed to a fixed number of bits.
The kernel of two texts is the number of n-grams they share over the geometric mean of their numbers.  With landmark texts the Nystroem
map K(x, landmarks) K(landmarks, landmarks)^(-1/2) makes kernel ridge regression a small linear system; one regression per language is
fitted against the rest, and a batch of texts is scored by two matrix products.  Long texts vote piece by piece, so that every part of
the whole text counts and the size of a set stays comparable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BYTE_VALUES, LOWER, PIECE_BYTES, Spans, Texts, U, pieces, unused

SIZES = (1, 2, 3, 4)  # bytes of an n-gram
BITS = 1 << 12
PIECE = 1000  # bytes of a text that form one set
LANDMARKS = 192
UNKNOWN = "und"


def presence(texts: Texts, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of BITS presences as float32, text of each row) of at most about PIECE_BYTES bytes at a time, so that memory does not grow
    with a text; texts without bytes have no row.
    """
    step, sizes = PIECE_BYTES - PIECE_BYTES % piece, np.diff(texts.offsets)
    long = np.flatnonzero(sizes > step)
    edges = np.unique([0, *long, *(long + 1), len(sizes)])
    for a, z in zip(edges[:-1], edges[1:]):
        start, end = texts.offsets[a], texts.offsets[z]
        if sizes[a] > step:
            for at in range(start, end, step):
                part = texts.buffer[at : min(at + step, end)]
                rows, text = _presence(part, np.array([0, len(part)]), piece)
                yield rows, text + a
        else:
            rows, text = _presence(texts.buffer[start:end], texts.offsets[a : z + 1] - start, piece)
            yield rows, text + a


def _presence(buffer: np.ndarray, offsets: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    buffer = LOWER[buffer]
    sizes = np.diff(offsets)
    count = -(-sizes // piece)
    text = np.repeat(np.arange(len(sizes)), count)
    row_of_text = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(sizes)), sizes)
    row = row_of_text[owner] + (np.arange(len(buffer)) - offsets[owner]) // piece
    out = np.zeros((int(count.sum()), BITS), np.float32)
    spans = Spans(BYTE_VALUES[buffer])
    for n in SIZES:
        grams = spans.rolling(n)
        same = row[: len(grams)] == row[n - 1 :][: len(grams)]
        out[row[: len(grams)][same], (grams[same] % U(BITS)).astype(np.int64)] = 1
    return out, text


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # BITS x landmarks, presences over the root of their number
    weights: np.ndarray  # landmarks x languages: the inverse root of the landmark kernel times the ridge solutions
    offset: np.ndarray

    def decide(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score from 0 to 1) of every text, -1 and 0 where there is nothing to go by."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.languages:
            return best, score
        votes, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for rows, text in presence(texts):
            norm = np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
            value = (rows @ self.landmarks) / norm @ self.weights + self.offset
            np.add.at(votes, text, value * norm)  # a longer piece counts more
            weight += np.bincount(text, norm[:, 0], len(texts))
        has = weight > 0
        if has.any():
            votes[has] /= weight[has, None]
            soft = np.exp((votes - votes.max(1, keepdims=True)) * 4)
            soft /= soft.sum(1, keepdims=True)
            best[has], score[has] = votes.argmax(1)[has], soft.max(1)[has]
        return best, score


def fit(rows: pa.RecordBatch, labels: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2, seed: int = 11) -> Model:
    """Kernel ridge regressions, one per language against the rest, of the pieces of the given texts."""
    languages = sorted(set(labels))
    parts, owners, at = [], [], 0
    for texts in pieces(iter([rows])):
        for part, text in presence(texts):
            parts.append(part)
            owners.append(text + at)
        at += len(texts)
    x, owner = (np.concatenate(parts), np.concatenate(owners)) if parts else (np.zeros((0, BITS), np.float32), np.zeros(0, int))
    if not len(x):
        return Model([], np.zeros((BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in labels])[owner]
    x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    # landmarks from every language alike
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: -(-landmarks // len(languages))] for k in range(len(languages))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = (x @ marks.T) @ root
    share = np.bincount(y, minlength=len(languages)) / len(y)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, 0.0)
    weight = (1 / share[y])[:, None]  # every language counts alike
    mean = (features * weight).sum(0) / weight.sum()
    centre = (target * weight).sum(0) / weight.sum()
    system = ((features - mean) * weight).T @ (features - mean) / weight.sum() + ridge * np.eye(features.shape[1]) / 10
    solution = np.linalg.solve(system, ((features - mean) * weight).T @ (target - centre) / weight.sum())
    return Model(languages, np.ascontiguousarray(marks.T), root @ solution, centre - mean @ solution)


def sample(docs: DataFrame, most: int = 1500, least_chars: int = 40, most_chars: int = 4000, part: int = 2, parts: int = 4) -> tuple[pa.RecordBatch, list[str]]:
    """A bounded, repeatable sample of labelled rows whose crc32(doc_id) modulo parts is not part: about `most` texts, as many from each
    language as there are, but at least 8 from every language that has them, in the order of a hash of the id.

    Texts of least_chars to most_chars characters come first; where a language has too few of them, shorter texts and passages of
    most_chars characters from longer ones fill up, so that no language is left out.
    """
    rule = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) != part
    rows = docs.where(rule & F.col("lang").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    each = max(8, most // max(1, rows.select("lang").distinct().count()))
    ranked = rows.select("doc_id", "lang", F.length("text").between(least_chars, most_chars).alias("_fits"), F.xxhash64("doc_id", "text").alias("_t"))
    first = Window.partitionBy("lang").orderBy(F.desc("_fits"), F.xxhash64("doc_id"), "doc_id", "_t")
    ids = ranked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).select("doc_id", "lang", "_t").distinct()
    spare = F.greatest(F.length("text") - most_chars, F.lit(0))
    passage = F.substring("text", (F.pmod(F.col("_t"), spare + 1) + 1).cast("int"), F.lit(most_chars))
    got = rows.withColumn("_t", F.xxhash64("doc_id", "text")).join(ids, ["doc_id", "lang", "_t"]).select("doc_id", "lang", passage.alias("text"))
    table = got.distinct().toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")]).combine_chunks()
    if not table.num_rows:
        return pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), []
    return table.to_batches()[0], table["lang"].to_pylist()


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all if None), lang_pred and score (0 to 1) from the whole text alone.

    Null texts and texts without a letter are `und` with score 0, and so is every text if nothing could be learned.  Repeated rows get
    the same result.  Existing columns of these two names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    name = unused("_whole", docs)
    text = F.when(F.col("text").cast("string").rlike(r"\p{L}"), F.lower(F.col("text").cast("string")))
    rows = docs.select(text.alias(name), *[F.col(c) for c in keep])
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches, 0):
            best, score = shared.value.decide(texts)
            names = pa.array([shared.value.languages[b] if b >= 0 else UNKNOWN for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*texts.rows.columns[1:], names, pa.array(score)], names=schema.names)

    return rows.mapInArrow(run, schema)
