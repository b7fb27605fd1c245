"""Substring deduplication on a compacted De Bruijn graph of words.

Every run of `window` words is an edge (a token k-mer) from the words before its last to the words after its first.  Edges that follow
each other in a text and share the smallest hash of their short inner k-mers, their anchor, form one path: where a run of words repeats,
its anchor and its path repeat with it, so equal edges always meet under one anchor.  Paths that occur twice are repeated whole.  Paths
that share an anchor but differ branch somewhere inside, and a path that meets its anchor twice may hold an edge twice; only these
are opened into their single edges.  Repeated paths that follow each
other without a branch (one successor and one predecessor wherever they occur) compact into long ones.  Each result is a span of words
in a document, its source coordinates, which are merged and cut out.

An edge is identified by two 64-bit hashes, of its anchor and of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import Spans, Texts, U, cut, mix, pieces, ranges, smallest_in_window, union

INNER = 8  # words of the inner k-mers, among which the anchor is chosen


class Paths:
    """All paths of some texts: text, first edge (word number within the text), edges, anchor, content."""

    def __init__(self, texts: Texts, window: int, inner: int):
        words = texts.words()
        self.words, self.spans, self.window = words, Spans(words.hash), window
        edges = np.maximum(words.count - window + 1, 0)
        inner_hash = mix(self.spans.rolling(inner) + U(0x632BE59BD9B4E019))
        smallest = smallest_in_window(inner_hash, window - inner + 1)
        at = ranges(words.first[:-1], edges)  # edges that lie within one text
        text = np.repeat(np.arange(len(texts)), edges)
        low = smallest[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        self.count = np.diff(np.concatenate([begin, [len(at)]]))
        self.text, self.anchor, self.at = text[begin], low[begin].view(np.int64), at[begin]
        # the anchor may stand at two places of one path, which may then hold an edge twice
        width = self.count + window - inner
        seen = inner_hash[ranges(self.at, width)] == np.repeat(low[begin], width)
        self.twice = np.add.reduceat(seen, np.cumsum(width) - width) > 1 if len(begin) else np.zeros(0, bool)
        self.start = self.at - words.first[self.text]
        self.content = Spans(words.hash, base=0x2545F4914F6CDD1D).hash(self.at, self.at + self.count + window - 1).view(np.int64)
        same = self.text[1:] == self.text[:-1] if len(begin) else np.zeros(0, bool)
        # half of the neighbour's hash, enough to tell whether a path goes on alike everywhere; 0: none
        self.after, self.before = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        half = (self.content >> 33).astype(np.int32) | 1
        self.after[:-1][same] = half[1:][same]
        self.before[1:][same] = half[:-1][same]


def _paths(docs: DataFrame, window: int, inner: int) -> DataFrame:
    schema = docs.select("doc_id", "text_key").schema
    schema.add("anchor", "long").add("content", "long").add("before", "integer").add("after", "integer").add("start", "integer").add("edges", "integer").add("twice", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            p = Paths(texts, window, inner)
            rows = pa.array(p.text)
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id").take(rows), texts.rows.column("text_key").take(rows), pa.array(p.anchor), pa.array(p.content), pa.array(p.before), pa.array(p.after),
                pa.array(p.start.astype(np.int32)), pa.array(p.count.astype(np.int32)), pa.array(p.twice),
            ], names=schema.names)

    return docs.mapInArrow(run, schema)


def _edges(branching: DataFrame, window: int) -> DataFrame:
    """branching(doc_id, text_key, text, spans<start, edges, anchor, single>) -> every edge of these paths, by its coordinates."""
    schema = branching.select("doc_id", "text_key").schema.add("anchor", "long").add("single", "boolean").add("edge", "long").add("at", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            words = texts.words()
            rolling = Spans(words.hash, base=0x2545F4914F6CDD1D).rolling(window)
            lists = texts.rows.column("spans")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, edges = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            at = ranges(words.first[owner] + start, edges)
            rows, which = pa.array(np.repeat(owner, edges)), pa.array(np.repeat(np.arange(len(owner)), edges))
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id").take(rows), texts.rows.column("text_key").take(rows), flat.field(2).take(which), flat.field(3).take(which),
                pa.array(rolling[at].view(np.int64)), pa.array((at - words.first[np.repeat(owner, edges)]).astype(np.int32)),
            ], names=schema.names)

    return branching.mapInArrow(run, schema)


def _cut_out(rows: DataFrame, window: int, texts_too: bool) -> DataFrame:
    schema = rows.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    schema.add("spans", ArrayType(StructType().add("start", "long").add("end", "long")))
    if texts_too:
        schema.add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            words = texts.words()
            out: list[list] = [[] for _ in schema.names]
            ids, spans, data = texts.rows.column("doc_id").to_pylist(), texts.rows.column("spans").to_pylist(), texts.buffer
            for i in range(len(texts)):
                first, n = int(words.first[i]), int(words.count[i])
                gone = np.zeros(n, bool)
                a, z = (np.array([s[k] for s in spans[i] or []], np.int64) for k in ("start", "end"))
                a, z = union(a, z)
                gone[ranges(a, z - a)] = True
                whole = data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
                kept = b" ".join(w for w, g in zip(whole.split(), gone) if not g) if len(a) else b" ".join(whole.split())
                row = [ids[i], n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in zip(a, z)], kept.decode()]
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [texts.rows.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeated_paths(docs: DataFrame, window: int = 35, inner: int = INNER) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text_key, text) -> (paths, spans).

    paths: anchor, content, n (occurrences), open (branching, so only some of its edges may repeat), and whether it goes on to one
    successor and comes from one predecessor wherever it occurs.  spans: doc_id, text_key, start, end and path, the coordinates of all
    repeated words, compacted: a span of non-branching paths is one row with the content of its first path.
    """
    found = _paths(docs, window, inner)
    # anchors that occur once hold nothing that repeats; the others' paths are all that goes on from here
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.max("twice").alias("_t")).where("_n > 1 OR _t").select("anchor")
    shared = cut(found.join(anchors, "anchor", "left_semi"))
    stats = shared.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min("after").alias("_a"), F.max("after").alias("_z"), F.min("before").alias("_b"), F.max("before").alias("_y"),
        F.max("twice").alias("twice"), F.min(F.struct("doc_id", "text_key", "start", "edges")).alias("at"),
    )
    kinds = stats.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds"))
    paths = cut(stats.join(kinds, "anchor").select(
        "anchor", "content", "n", ((F.col("_kinds") > 1) | F.col("twice")).alias("open"), ((F.col("_a") == F.col("_z")) & (F.col("_a") != 0)).alias("one_after"),
        ((F.col("_b") == F.col("_y")) & (F.col("_b") != 0)).alias("one_before"), "at",
    ))
    # branching paths, each opened at one place: an edge that is met twice repeats
    opened = paths.where("open").groupBy(F.col("at.doc_id").alias("_d"), F.col("at.text_key").alias("_k")).agg(F.collect_list(F.struct("at.start", "at.edges", "anchor", (F.col("n") == 1).alias("single"))).alias("spans"))
    branching = docs.join(opened, docs["doc_id"].eqNullSafe(opened["_d"]) & (docs["text_key"] == opened["_k"])).select("doc_id", "text_key", "text", "spans")
    edges = _edges(branching.dropDuplicates(["doc_id", "text_key"]), window)
    twice = edges.groupBy("anchor", "edge").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor", "edge")
    parts = edges.where("single").join(twice, ["anchor", "edge"], "left_semi").select("doc_id", "text_key", F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    # all places of the paths that occur twice as a whole, joined along the text where nothing branches
    whole = paths.where("n > 1").select("anchor", "content", "one_after", "one_before")
    places = shared.select("doc_id", "text_key", "anchor", "content", "start", "edges").join(whole, ["anchor", "content"])
    along = Window.partitionBy("doc_id", "text_key").orderBy("start")
    goes_on = F.col("one_before") & F.lag("one_after").over(along) & ((F.lag("start").over(along) + F.lag("edges").over(along)) == F.col("start"))
    runs = places.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along))
    long_ = runs.groupBy("doc_id", "text_key", "_run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("edges") + window - 1).alias("end"), F.min_by("content", "start").alias("path"))
    spans = long_.select("doc_id", "text_key", "start", "end", "path").unionByName(parts.withColumn("path", F.lit(None).cast("long")))
    return paths, spans


def remove_repeats(docs: DataFrame, window: int = 35, inner: int = INNER, texts: bool = True) -> DataFrame:
    """docs -> doc_id, n_words, n_removed, kept_sha256, spans (removed words, from start to before end) and, if texts, kept_text.

    A window is `window` consecutive words of one document; words of every window whose word sequence starts anywhere else too are
    removed, judged on the input.  Null texts count as empty; texts shorter than a window keep all words; a null doc_id is a document
    like any other; repeated rows repeat each other's windows.  Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    _, spans = repeated_paths(rows, window, inner)
    of_text = spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(of_text, rows["doc_id"].eqNullSafe(of_text["_d"]) & (rows["text_key"] == of_text["_k"]), "left").select("doc_id", "text", "spans")
    return _cut_out(joined, window, texts)
