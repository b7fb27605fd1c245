"""Benchmark decontamination: item-sized windows by SimHash and a multi-index over Hamming blocks, verified exactly.

A benchmark item of n words is compared with every run of n words of a document (the whole document where it is shorter) that shares at
least one five-word shingle with it; any other window has similarity zero.  Windows get a 64-bit SimHash of their shingles.  The
fingerprints of the items of n words are indexed by eight blocks of eight bits: two fingerprints within RADIUS differ by two bits or
fewer in some block, so looking up every block within two bits finds all of them.  What is found is verified by the weighted Jaccard
similarity of the shingles, the weight of a shingle being how often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from .common import LOWER, Spans, Texts, U, Words, pieces, ranges, unused

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BITS = np.arange(64, dtype=U)
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
NEAR = np.array([[bin(a ^ b).count("1") <= RADIUS // 8 for b in range(256)] for a in range(256)])


class _Plain:
    """The texts of a piece without ASCII punctuation, so that words compare whatever stands around them."""

    def __init__(self, texts: Texts):
        keep = ~PUNCTUATION[texts.buffer]
        self.buffer = LOWER[texts.buffer[keep]]
        self.offsets = np.concatenate([[0], np.cumsum(keep)])[texts.offsets]


def plain_words(texts: Texts) -> Words:
    return Words(_Plain(texts), lower=False)


def simhashes(shingles: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of `size` shingles from each start."""
    votes = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(((shingles[:, None] >> BITS) & U(1)).astype(np.int32) * 2 - 1, axis=0, out=votes[1:])
    return (((votes[start + size] - votes[start]) > 0).astype(U) << BITS).sum(axis=1, dtype=U)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


class Index:
    """The items, by their number of words; items without words match nothing."""

    def __init__(self, items: pa.Table):
        self.by_size: dict[int, list[tuple[object, Counter]]] = {}
        prints: dict[int, list[int]] = {}
        known: dict[int, set[int]] = {}
        for texts in pieces(iter(items.select(["item_id", "text"]).to_batches())):
            words = plain_words(texts)
            ids = texts.rows.column("item_id").to_pylist()
            for i, n in enumerate(words.count.tolist()):
                if not n:
                    continue
                shingles = Spans(words.hash[words.first[i] : words.first[i + 1]]).rolling(min(n, SHINGLE))
                self.by_size.setdefault(n, []).append((ids[i], Counter(shingles.tolist())))
                prints.setdefault(n, []).append(int(simhashes(shingles, np.zeros(1, np.int64), len(shingles))[0]))
                known.setdefault(n, set()).update(shingles.tolist())
        self.prints = {n: np.array(v, U) for n, v in prints.items()}
        self.known = {n: np.array(sorted(v), U) for n, v in known.items()}
        # per item size and block: which items lie within two bits of each of the 256 values
        self.near = {n: np.stack([NEAR[:, ((v >> U(8 * k)) & U(255)).astype(int)] for k in range(8)]) for n, v in self.prints.items()}
        self.maybe = {}
        for size in {min(n, SHINGLE) for n in self.prints}:
            self.maybe[size] = np.zeros(1 << 20, bool)
            for n, v in self.known.items():
                if min(n, SHINGLE) == size:
                    self.maybe[size][(v & U(0xFFFFF)).astype(int)] = True

    def candidates(self, n: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint number, item number) of all pairs within RADIUS."""
        close = np.zeros((len(found), len(self.prints[n])), bool)
        for k in range(8):
            close |= self.near[n][k][((found >> U(8 * k)) & U(255)).astype(int)]
        w, i = np.nonzero(close)
        far = np.bitwise_count(found[w] ^ self.prints[n][i]) > RADIUS
        return w[~far], i[~far]

    def search(self, texts: Texts) -> list[list[dict]]:
        """The best window of each item that each text contains."""
        words = plain_words(texts)
        out: list[dict] = [{} for _ in range(len(texts))]
        if not len(words.hash):
            return [[] for _ in out]
        text_of, spans = words.text_of(), Spans(words.hash)
        for size, maybe in self.maybe.items():
            shingles = spans.rolling(size)
            at = np.flatnonzero(maybe[(shingles & U(0xFFFFF)).astype(int)])
            at = at[words.first[text_of[at] + 1] - at >= size]  # inside one text
            for n, known in self.known.items():
                if min(n, SHINGLE) != size or not len(at):
                    continue
                hits = at[known[np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)] == shingles[at]]
                if len(hits):
                    self._windows(n, size, hits, shingles, words, text_of, out)
        return [sorted(v.values(), key=lambda h: (h["start"], str(h["item_id"]))) for v in out]

    def _windows(self, n: int, size: int, hits: np.ndarray, shingles: np.ndarray, words, text_of: np.ndarray, out: list[dict]) -> None:
        text = text_of[hits]
        first, end = words.first[text], words.first[text + 1]
        width = np.minimum(n, end - first)  # a text shorter than the item is one window
        low, high = np.maximum(first, hits - (width - size)), np.minimum(hits, end - width)
        for w in np.unique(width):
            of = width == w
            starts = np.unique(ranges(low[of], high[of] - low[of] + 1))
            count = int(w) - size + 1
            for part in np.array_split(starts, -(-len(starts) // 20_000)):
                base, last = part[0], part[-1] + count
                if last - base > 4 * len(part) * count + 1000:  # far apart: gather only what is needed
                    need = np.unique(ranges(part, np.full(len(part), count)))
                    prints = simhashes(shingles[need], np.searchsorted(need, part), count)
                else:
                    prints = simhashes(shingles[base:last], part - base, count)
                for k, i in zip(*self.candidates(n, prints)):
                    s = int(part[k])
                    item, bag = self.by_size[n][i]
                    similarity = weighted_jaccard(Counter(shingles[s : s + count].tolist()), bag)
                    if similarity >= SIMILARITY:
                        t = int(text_of[s])
                        hit = {"item_id": item, "start": s - int(words.first[t]), "n_words": int(w), "similarity": similarity}
                        if i not in out[t].setdefault("_", {}) or similarity > out[t]["_"][i]["similarity"]:
                            out[t]["_"][i] = hit
                            out[t][(n, i)] = hit
        for found in out:
            found.pop("_", None)


def search(docs: DataFrame, benchmark: DataFrame, items_per_pass: int = 20_000, keep: list[str] | None = None, column: str = "_hits") -> DataFrame:
    """The columns `keep` of docs (all if None) and the benchmark items that each whole text contains, as an array
    column<item_id, start, n_words, similarity> in order of place; start counts words without punctuation.

    Null and empty texts contain nothing; null, empty and pure-punctuation items match nothing; equal items match alike.  A benchmark of
    more items than items_per_pass is taken in blocks, each with a pass of its own, so no index grows with it.
    """
    keep = docs.columns if keep is None else keep
    items = benchmark.select("item_id", F.lower(F.col("text").cast("string")).alias("text"))
    blocks = max(1, -(-items.count() // items_per_pass))
    hit = StructType().add("item_id", benchmark.schema["item_id"].dataType).add("start", "long").add("n_words", "integer").add("similarity", "double")
    whole_name = unused("_whole", docs)
    kind = to_arrow_type(ArrayType(hit))
    rows = docs.select(F.lower(F.col("text").cast("string")).alias(whole_name), *[F.col(c) for c in keep], F.lit(None).cast(ArrayType(hit)).alias(column))
    for block in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast(Index(chosen.toArrow()))
        schema = (rows if block + 1 < blocks else rows.drop(whole_name)).schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=schema.names) -> Iterator[pa.RecordBatch]:
            for texts in pieces(batches, 0):
                whole, *rest, before = texts.rows.columns
                found = shared.value.search(texts)
                if before.null_count < len(before):  # an earlier block of items found some
                    found = [(a or []) + b for a, b in zip(before.to_pylist(), found)]
                columns = [*rest, pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays([whole, *columns] if len(names) > len(columns) else columns, names=names)

        rows = rows.mapInArrow(run, schema)
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, items_per_pass: int = 20_000) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, start, n_words, similarity."""
    found = search(docs, benchmark, items_per_pass, keep=["doc_id"])
    return found.select("doc_id", F.explode("_hits").alias("_h")).select("doc_id", "_h.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item, all columns."""
    name = unused("_hits", docs)
    return search(docs, benchmark, column=name).where(F.size(name) == 0).select(*docs.columns)
