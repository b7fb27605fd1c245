"""Whole texts as flat numpy arrays inside Arrow tasks, and small Spark helpers.

A task sees the texts of a batch as one UTF-8 buffer with offsets; words are runs of bytes other than space and 0x09-0x0D.  Every
hash is a polynomial over prefix sums modulo 2^64, so the hash of any span costs two look-ups whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

U = np.uint64
PIECE_BYTES = 1 << 20  # texts handled together in one step; a longer text is a step of its own
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class Spans:
    """Hashes of spans of one sequence of 64-bit values."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = 0x5851F42D4C957F2D):
        n = len(values)
        up, down = self._powers.get(base, (np.ones(0, U), np.ones(0, U)))
        if len(up) <= n:
            up = np.full(n + 1, base, U)
            down = np.full(n + 1, pow(base, -1, 1 << 64), U)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if n <= 4 * PIECE_BYTES:
                self._powers[base] = (up, down)
        self._down, self._sums = down, np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U))

    def rolling(self, size: int) -> np.ndarray:
        """Of every span of this size."""
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, U)
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n] + U(size))


class Texts:
    """Some rows of an Arrow batch: rows (slice of the batch), buffer and offsets of the texts."""

    def __init__(self, rows: pa.RecordBatch, column: str | int):
        self.rows = rows
        array = rows.column(column)
        array = (array if array.null_count == 0 else array.fill_null("")).cast(pa.large_string())
        if array.offset:
            array = pa.concat_arrays([array, pa.array([], pa.large_string())])
        _, offsets, data = array.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
        base = self.offsets[0]
        self.buffer = np.frombuffer(data, np.uint8)[base : self.offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
        self.offsets = self.offsets - base

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


class Words:
    """start and end byte of every word, its hash, and first[i]: number of the first word of text i."""

    def __init__(self, texts: Texts, lower: bool):
        b, offs = texts.buffer, texts.offsets
        inside = ~SPACE[b]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offs[(offs > 0) & (offs < len(b))]  # a text's end also ends a word
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.hash = Spans(BYTE_VALUES[LOWER[b] if lower else b]).hash(self.start, self.end)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def pieces(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = PIECE_BYTES) -> Iterator[Texts]:
    """The rows of all batches in runs of bounded bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(column)
        sizes = np.array(pc.fill_null(pc.binary_length(array), 0), np.int64)
        run = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield Texts(batch.slice(a, z - a), column)


def smallest_in_window(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of size values."""
    done, out = 1, values
    while done * 2 <= size:
        out = np.minimum(out[: len(out) - done], out[done:]) if len(out) > done else out[:0]
        done *= 2
    if done < size:
        step = size - done
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] values, and so on."""
    total = int(length.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(total) if total else np.zeros(0, np.int64)


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open spans joined where they overlap or touch, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores added until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ensure_checkpoints(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a folder of its own only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            shared = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends here, lost executors do not matter, the engine removes the files."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) of longs -> (id, component): the smallest id reachable, for every id in links.

    Labels pass over links and then over labels (pointer jumping), so the rounds grow with the logarithm of the longest chain; a hot id
    is pre-aggregated by the minimum on the map side.
    """
    edges = cut(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("c")))
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("n"))
        step = labels.join(near, "id").select("id", F.least("c", "n").alias("d"), F.col("c").alias("old"))
        # hooking: the old label learns of the smaller one too
        hook = step.where("d < old").groupBy(F.col("old").alias("h")).agg(F.min("d").alias("hd"))
        nxt = step.join(hook, F.col("id") == F.col("h"), "left").select("id", F.least("d", F.coalesce("hd", "d")).alias("d"), "old")
        roots = nxt.select(F.col("id").alias("r"), F.col("d").alias("rd"))
        nxt = cut(nxt.join(roots, F.col("d") == F.col("r"), "left").select("id", F.least("d", F.coalesce("rd", "d")).alias("c"), "old"))
        changed = nxt.where("c <> old").limit(1).count()
        labels = nxt.select("id", "c")
        if not changed:
            return labels.withColumnRenamed("c", "component")
    raise RuntimeError("components did not settle")
