"""Suffix-array deduplication: bytes of strings of `length` bytes that occur more than once.

Texts are cut into blocks: maximal runs of starting points whose strings share the smallest hash of their short inner strings, the
anchor.  Equal strings have equal anchors, so they lie in blocks of one anchor.  Blocks with equal bytes are stored once with their
number; anchors that occur once are done.  What is left, different blocks under one anchor, is dealt to shards by the anchor (a frequent
anchor is split further by a second one).  Each shard leaves out blocks that differ from all others next to their anchor, builds the suffix
array of the rest by induced sorting and finds, by permuted common prefixes, which strings start twice.  An anchor whose blocks alone are larger than a shard, such as that of a passage within a string's length in
very many texts, goes to no shard: its strings are counted in Spark by two 64-bit hashes, so no task holds them together.  Source
coordinates lead back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import BYTE_VALUES, Spans, Texts, U, cut, mix, pieces, ranges, smallest_in_window, union
from .suffix_arrays import repeated_starts

INNER = 48  # bytes of the inner strings
SHARD_BYTES = 2_000_000  # aimed at for a shard; a shard is one task's group


def _runs(buffer: np.ndarray, offsets: np.ndarray, length: int, inner: int):
    """(text, first start within the buffer, starts, anchor, inner hashes) of the blocks of some texts."""
    hashes = mix(Spans(BYTE_VALUES[buffer]).rolling(inner) + U(0x2C1B3C6D))
    smallest = smallest_in_window(hashes, length - inner + 1)
    starts = np.maximum(np.diff(offsets) - length + 1, 0)
    at, text = ranges(offsets[:-1], starts), np.repeat(np.arange(len(starts)), starts)
    low = smallest[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], at[begin], np.diff(np.concatenate([begin, [len(at)]])), low[begin], hashes


def _blocks(docs: DataFrame, length: int, inner: int) -> DataFrame:
    schema = docs.select("doc_id", "text_key").schema.add("anchor", "long").add("content", "long").add("start", "integer").add("starts", "integer").add("twice", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            text, at, count, anchor, hashes = _runs(texts.buffer, texts.offsets, length, inner)
            content = Spans(BYTE_VALUES[texts.buffer], base=0x2545F4914F6CDD1D).hash(at, at + count + length - 1).view(np.int64)
            width = count + length - inner  # the anchor may stand at two places of a block, which may then hold a string twice
            twice = np.add.reduceat(hashes[ranges(at, width)] == np.repeat(anchor, width), np.cumsum(width) - width) > 1 if len(at) else np.zeros(0, bool)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id").take(rows), texts.rows.column("text_key").take(rows), pa.array(anchor.view(np.int64)), pa.array(content),
                pa.array((at - texts.offsets[text]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice),
            ], names=schema.names)

    return docs.mapInArrow(run, schema)


def _block_texts(rows: DataFrame, length: int, inner: int) -> DataFrame:
    """rows(doc_id, text_key, text, blocks<start, starts, anchor, n, split, hot>) -> the bytes of the blocks that are not hot; those to be
    split, in parts by a second anchor."""
    schema = rows.select("doc_id", "text_key").schema.add("anchor", "long").add("second", "long").add("n", "long").add("inner", "integer").add("start", "integer").add("bytes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            lists = texts.rows.column("blocks")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, starts, anchor, n, split, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            out: list[list] = [[] for _ in range(6)]
            for i, o in enumerate(owner):
                if hot[i]:
                    continue
                a = int(texts.offsets[o] + start[i])
                part = texts.buffer[a : a + int(starts[i]) + length - 1]
                cuts, second = np.array([0]), np.zeros(1, np.int64)
                if split[i]:  # by the smallest of other inner hashes, which equal strings share as well
                    low = smallest_in_window(mix(Spans(BYTE_VALUES[part], base=0x27BB2EE687B0B0FD).rolling(inner // 2)), length - inner // 2 + 1)
                    cuts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                    second = low[cuts].view(np.int64)
                for b, e, s in zip(cuts, [*cuts[1:], int(starts[i])], second):
                    for column, value in zip(out, (o, anchor[i], s, n[i], int(start[i] + b), part[b : e + length - 1].tobytes())):
                        column.append(value)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([
                texts.rows.column("doc_id").take(take), texts.rows.column("text_key").take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                pa.array(out[3], pa.int64()), pa.array(np.full(len(take), inner, np.int32)), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary()),
            ], names=schema.names)

    return rows.mapInArrow(run, schema)


def _strings(rows: DataFrame, length: int, at_once: int = 1 << 18) -> DataFrame:
    """rows as for _block_texts -> two hashes of every string of the hot blocks, its start, and whether the block occurs once."""
    schema = rows.select("doc_id", "text_key").schema.add("first", "long").add("other", "long").add("start", "long").add("once", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            for o, blocks in enumerate(texts.rows.column("blocks")):
                flat = blocks.values
                start, starts, _, n, _, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                for i in np.flatnonzero(hot):
                    for a in range(0, int(starts[i]), at_once):
                        count = min(at_once, int(starts[i]) - a)
                        begin = int(start[i]) + a
                        part = BYTE_VALUES[texts.buffer[texts.offsets[o] + begin : texts.offsets[o] + begin + count + length - 1]]
                        first, other = (Spans(part, base=base).rolling(length).view(np.int64) for base in (0x5851F42D4C957F2D, 0x369DEA0F31A53F85))
                        take = pa.array(np.full(count, o))
                        yield pa.RecordBatch.from_arrays([
                            texts.rows.column("doc_id").take(take), texts.rows.column("text_key").take(take), pa.array(first), pa.array(other),
                            pa.array(np.arange(begin, begin + count)), pa.array(np.full(count, n[i] == 1)),
                        ], names=schema.names)

    return rows.mapInArrow(run, schema)


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """rows as for _block_texts -> doc_id, text_key, start, end of repeated bytes in hot blocks that occur once."""
    strings = _strings(rows, length)
    repeated = strings.groupBy("first", "other").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("first", "other")
    starts = strings.where("once").join(repeated, ["first", "other"], "left_semi")
    run = F.col("start") - F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("start"))  # of one text
    return starts.select("doc_id", "text_key", "start", run.alias("_run")).groupBy("doc_id", "text_key", "_run").agg(
        F.min("start").alias("start"), (F.max("start") + length).alias("end"),
    ).drop("_run")


def _promising(parts: list[np.ndarray], size: np.ndarray, anchor: np.ndarray, length: int, inner: int, steps: int = 8) -> np.ndarray:
    """Whether a block has much of the surroundings of its anchor in common with another place of that anchor; no other block can repeat a string.

    A string holds its anchor with `length - inner` more bytes before and after it.  In steps of an eighth of these, equal strings have at
    least seven whole steps around their anchors in common, so one of the eight ways to deal seven steps to both sides is equal in both.
    """
    step = (length - inner) // steps
    if step < 1:
        return np.ones(len(parts), bool)
    begin = np.cumsum(size) - size
    spans = Spans(BYTE_VALUES[np.concatenate(parts)])
    hashes = mix(spans.rolling(inner) + U(0x2C1B3C6D))
    owner = np.repeat(np.arange(len(parts)), size)[: len(hashes)]
    place = np.flatnonzero(hashes == anchor[owner])
    owner = owner[place]
    first, last = begin[owner], begin[owner] + size[owner]
    keys, blocks = [], []
    for before in range(steps):
        a, z = place - step * before, place + inner + step * (steps - 1 - before)
        inside = (a >= first) & (z <= last)
        keys.append(spans.hash(a[inside], z[inside]))
        blocks.append(owner[inside])
    _, key, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    out = np.zeros(len(parts), bool)
    out[np.concatenate(blocks)[n[key] > 1]] = True
    return out


def _sort_shard(table: pa.Table, length: int) -> pa.Table:
    """One shard: rows(doc_id, text_key, anchor, n, inner, start, bytes) -> doc_id, text_key, start, end of repeated bytes in blocks that occur once."""
    parts = [np.frombuffer(b.as_buffer(), np.uint8) for b in table["bytes"]]
    size = np.array([len(p) for p in parts])
    stay = _promising(parts, size, table["anchor"].to_numpy().view(U), length, table["inner"][0].as_py())
    if not stay.any():
        none = pa.array([], pa.int64())
        return table.slice(0, 0).select(["doc_id", "text_key"]).append_column("start", none).append_column("end", none)
    table, parts, size = table.filter(pa.array(stay)), [p for p, ok in zip(parts, stay) if ok], size[stay]
    at = np.cumsum(size + 1) - size - 1
    text = np.ones(int((size + 1).sum()) + 1, np.int32)  # 1 ends a block, 0 all
    text[-1] = 0
    text[ranges(at, size)] = np.concatenate(parts).astype(np.int32) + 2
    twice = repeated_starts(text, length)
    left = np.repeat(at + size, size + 1) - np.arange(len(text) - 1)
    good = np.flatnonzero(twice[:-1] & (left >= length))
    owner = np.searchsorted(at, good, side="right") - 1
    good, owner = (x[(table["n"].to_numpy() == 1)[owner]] for x in (good, owner))
    new = np.ones(len(good), bool)
    new[1:] = (good[1:] != good[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(good)]])[: len(begin)] - 1
    first = table["start"].to_numpy()[owner[begin]] + good[begin] - at[owner[begin]]
    take = pa.array(owner[begin])
    return pa.table({
        "doc_id": table["doc_id"].combine_chunks().take(take), "text_key": table["text_key"].combine_chunks().take(take),
        "start": pa.array(first.astype(np.int64)), "end": pa.array((first + good[end] - good[begin] + length).astype(np.int64)),
    })


def repeated_bytes(docs: DataFrame, length: int = 400, inner: int = INNER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs(doc_id, text_key, text) -> doc_id, text_key, start, end: bytes of strings that start anywhere else too."""
    found = _blocks(docs, length, inner)
    stats = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(F.struct("doc_id", "text_key", "start", "starts")).alias("at"))
    shared = stats.groupBy("anchor").agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_kinds"), F.max("twice").alias("_t"), F.sum(F.col("at.starts").cast("long") + length).alias("_bytes"),
    ).where("_n > 1 OR _t")
    blocks = cut(stats.join(shared, "anchor").select("anchor", "content", "n", ((F.col("_kinds") > 1) | F.col("twice")).alias("open"), (F.col("_bytes") > shard_bytes / 4).alias("split"), (F.col("_bytes") > shard_bytes).alias("hot"), "at"))
    open_ = blocks.where("open")
    size = {r["hot"]: r["size"] for r in open_.groupBy("hot").agg(F.sum(F.col("at.starts").cast("long") + length).alias("size")).collect()}
    shards = max(1, int(size.get(False, 0) // shard_bytes))
    of_doc = open_.groupBy(F.col("at.doc_id").alias("_d"), F.col("at.text_key").alias("_k")).agg(F.collect_list(F.struct("at.start", "at.starts", "anchor", "n", "split", "hot")).alias("blocks"))
    rows = docs.join(of_doc, docs["doc_id"].eqNullSafe(of_doc["_d"]) & (docs["text_key"] == of_doc["_k"])).select("doc_id", "text_key", "text", "blocks").dropDuplicates(["doc_id", "text_key"])
    schema = docs.select("doc_id", "text_key").schema.add("start", "long").add("end", "long")
    texts = _block_texts(rows, length, inner).withColumn("shard", F.pmod(F.xxhash64("anchor", "second"), F.lit(shards)))
    sorted_ = texts.groupBy("shard").applyInArrow(lambda table: _sort_shard(table, length), schema)
    if True in size:
        sorted_ = sorted_.unionByName(_counted(rows, length))
    # blocks that occur twice are repeated whole, wherever they occur
    whole = blocks.where("n > 1").select("anchor", "content")
    places = found.join(whole, ["anchor", "content"], "left_semi").select(
        "doc_id", "text_key", F.col("start").cast("long").alias("start"), (F.col("start").cast("long") + F.col("starts") + length - 1).alias("end"),
    )
    return places.unionByName(sorted_)


def _cut_out(rows: DataFrame, texts_too: bool) -> DataFrame:
    schema = rows.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    schema.add("spans", ArrayType(StructType().add("start", "long").add("end", "long")))
    if texts_too:
        schema.add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            out: list[list] = [[] for _ in range(6)]
            for i, spans in enumerate(texts.rows.column("spans").to_pylist()):
                whole = texts.buffer[texts.offsets[i] : texts.offsets[i + 1]]
                a, z = union(*(np.array([s[k] for s in spans or []], np.int64) for k in ("start", "end")))
                stay = np.ones(len(whole), bool)
                stay[ranges(a, z - a)] = False
                kept = whole[stay].tobytes()
                row = (len(whole), len(whole) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in zip(a, z)], kept)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            arrays = [texts.rows.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays[: len(schema.names)], names=schema.names)

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 400, inner: int = INNER, shard_bytes: int = SHARD_BYTES, texts: bool = True) -> DataFrame:
    """docs -> doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (from start to before end) and, if texts,
    kept (the bytes that stay, which may end within a character).

    Every byte of a string of `length` bytes that also starts anywhere else is removed, judged on the input; overlaps count.  Null texts
    count as empty; shorter texts keep everything; a null doc_id is a document like any other; repeated rows repeat each other.  Other
    columns are not read; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    spans = repeated_bytes(rows, length, inner, shard_bytes)
    of_text = spans.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(of_text, rows["doc_id"].eqNullSafe(of_text["_d"]) & (rows["text_key"] == of_text["_k"]), "left").select("doc_id", "text", "spans")
    return _cut_out(joined, texts)
