"""N-gram Jaccard join: links between documents whose shingle sets are similar enough, by prefix trees.

Equal sets form one class.  All sets are ordered globally, rare shingles first (by a count sketch of fixed size, then by hash; any total
order gives the same links).  With s the least similarity and k = n // 20 + 1, two sets that link share at least the smaller of
their k shingles among the first n - ceil(s n) + k of each: classes that share fewer with all others link with none and drop out, the
others meet under their shared shingles.  The classes of a shingle, in the order of their sizes, fall apart wherever two neighbours are
too unequal to link: such chains are the groups from here on.  The sets that meet are stored in a trie: sorted, so that neighbours share a path, with the overlap of a path counted
once for all sets below it.  A query leaves a subtree when more of its path is missing than the longest set in the block may miss.

Groups of any size are dealt out in blocks of bounded size, and only links that connect something new leave a block, so no task holds a
group and no pair product is written.  First every class meets the leaders of its groups with which it has at least k of them in common;
what is then left unconnected in a group is compared in full, block against block.  A pair with fewer groups under its own leader has
others in common, led by a third class, and meets there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Spans, Texts, U, components, cut, mix, pieces

SKETCH = 1 << 18  # counters of the sketch, whatever the input
MASK = 1 << 23  # bits of the mask, whatever the input
BLOCK = 1024  # classes of one block
BLOCK_SHINGLES = 1 << 22  # and their shingles, on average


def shingle_sets(texts: Texts, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and their offsets; shorter texts are one shingle, texts without words none."""
    words = texts.words(lower=True)
    spans = Spans(words.hash)
    text = words.text_of()
    at = np.arange(len(text))
    whole = words.first[text + 1] - at >= ngram if len(text) else np.zeros(0, bool)
    start = at[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < ngram))
    values = np.concatenate([spans.hash(start, start + ngram), spans.hash(words.first[short], words.first[short + 1])])
    owner = np.concatenate([text[start], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


def class_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of every set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(values + U(0x9E3779B97F4A7C15)))])
    sizes = np.diff(offsets)
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ mix(sizes.astype(U) + U(1))).view(np.int64)


def at_least(size: np.ndarray | int, percent: int):
    """Smallest overlap that a set of this size needs in any link."""
    return -(-size * percent // 100)


def must_share(size: np.ndarray | int):
    """How many shingles of two prefixes must agree; the smallest partner's number counts."""
    return size // 20 + 1


def _sketch(docs: DataFrame, ngram: int) -> np.ndarray:
    """How many sets have a shingle in each of SKETCH hash buckets, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for texts in pieces(batches):
            values, _ = shingle_sets(texts, ngram)
            counts += np.bincount((values % U(SKETCH)).astype(np.int64), minlength=SKETCH)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    got = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _ordered(values: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sets with rare shingles first."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return values[np.lexsort((values, counts[(values % U(SKETCH)).astype(np.int64)], owner))]


def _classes(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, key, n) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            values, offsets = shingle_sets(texts, ngram)
            yield pa.RecordBatch.from_arrays([texts.rows.column("doc_id"), pa.array(class_keys(values, offsets)), pa.array(np.diff(offsets))], names=["doc_id", "key", "n"])

    return docs.mapInArrow(run, docs.select("doc_id").schema.add("key", "long").add("n", "long"))


def _prefixes(docs: DataFrame, counts, ngram: int, percent: int) -> DataFrame:
    """(shingle, key, n) for the shingles under which a class of n shingles may meet others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)  # copies within a task count once; at most one number for each of its documents
        for texts in pieces(batches):
            values, offsets = shingle_sets(texts, ngram)
            values, sizes, keys = _ordered(values, offsets, counts.value), np.diff(offsets), class_keys(values, offsets)
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            first &= ~np.isin(keys, seen)
            seen = np.concatenate([seen, keys[first]])
            length = np.where((sizes > 0) & first, np.minimum(sizes, sizes - at_least(sizes, percent) + must_share(sizes)), 0)
            rank = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
            take = rank < np.repeat(length, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(values[take].view(np.int64)), pa.array(np.repeat(keys, length)), pa.array(np.repeat(sizes, length))], names=["shingle", "key", "n"])

    return docs.mapInArrow(run, "shingle long, key long, n long")


def _mask(keys: DataFrame) -> np.ndarray:
    """One bit per hash bucket of the keys, MASK bits whatever their number; a set bit may stand for other keys too."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(key, {MASK}) % 32 as int))")
    words = keys.groupBy(F.expr(f"pmod(key, {MASK}) div 32").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(MASK // 32, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _sets(docs: DataFrame, counts, mask, ngram: int) -> DataFrame:
    """(key, n, tokens) with the whole set as bytes, in the order of the trie: frequent shingles first, so that near copies share a path.

    Only of keys that the mask lets through, so that neither texts nor sets of documents without partners are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)  # copies within a task count once
        for texts in pieces(batches):
            values, offsets = shingle_sets(texts, ngram)
            keys = class_keys(values, offsets)
            bucket = keys % MASK
            wanted = (mask.value[bucket // 32] >> (bucket % 32)) & 1 == 1
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            take = np.flatnonzero(wanted & first & ~np.isin(keys, seen))
            if not len(take):
                continue
            seen = np.concatenate([seen, keys[take]])
            ordered = _ordered(values, offsets, counts.value)
            data = [ordered[offsets[i] : offsets[i + 1]][::-1].tobytes() for i in take]
            yield pa.RecordBatch.from_arrays([pa.array(keys[take]), pa.array(np.diff(offsets)[take]), pa.array(data, pa.binary())], names=["key", "n", "tokens"])

    return docs.mapInArrow(run, "key long, n long, tokens binary")


class Trie:
    """Sets as sorted paths: number of shared shingles with the path before, and the shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.words, flat = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        paths = np.split(flat.astype(np.int32), cuts)
        # paths in the order of their bytes are neighbours where they share a beginning
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths])
        self.shared = np.zeros(len(paths), np.int64)
        for i in range(1, len(paths)):
            a, b = self.paths[i - 1], self.paths[i]
            m = min(len(a), len(b))
            apart = np.flatnonzero(a[:m] != b[:m])
            self.shared[i] = apart[0] if len(apart) else m
        self.may_miss = int((self.sizes - at_least(self.sizes, percent)).max())

    def linked(self, query: np.ndarray, wanted: np.ndarray) -> list[int]:
        """Numbers (of the given sets) of the wanted ones that link with query; wanted is by place in the trie."""
        has = np.zeros(len(self.words), bool)
        place = np.searchsorted(self.words, query)
        ok = place < len(self.words)
        ok[ok] = self.words[place[ok]] == query[ok]
        has[place[ok]] = True
        out, i, n = [], 0, len(self.paths)
        missed = np.zeros(int(self.sizes.max()) + 1, np.int32)  # on the present path, up to each depth
        valid = 0  # depth up to which missed holds for the path of set i
        while i < n:
            valid = min(valid, int(self.shared[i]))
            if not wanted[i]:
                i += 1
                continue
            path = self.paths[i]
            size = len(path)
            np.cumsum(~has[path[valid:]], out=missed[valid + 1 : size + 1])
            missed[valid + 1 : size + 1] += missed[valid]
            valid = size
            both = size - int(missed[size])
            if 100 * both >= self.percent * (size + len(query) - both):
                out.append(self.order[i])
            elif missed[size] > self.may_miss:  # the subtree from the depth at which too much is missing
                deep = int(np.searchsorted(missed[: size + 1], self.may_miss + 1))
                i += 1
                while i < n and self.shared[i] >= deep:
                    valid = min(valid, int(self.shared[i]))
                    i += 1
                continue
            i += 1
        return out


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """One block: rows(asks, stored, key, component, tokens); links that connect components, one for each connection made."""
    keys, label = table["key"].to_numpy(), table["component"].to_numpy()
    asks, stored = table["asks"].to_numpy(zero_copy_only=False), table["stored"].to_numpy(zero_copy_only=False)
    tokens = [np.frombuffer(x.as_buffer(), U) for x in table["tokens"]]
    members = np.flatnonzero(stored)
    names, comp = np.unique(label, return_inverse=True)
    found: list[tuple[int, int]] = []
    if len(members) and asks.any() and len(names) > 1:
        trie = Trie([tokens[m] for m in members], percent)
        place = members[trie.order]
        sizes = np.array([len(t) for t in tokens])
        for q in np.flatnonzero(asks):
            fits = (100 * np.minimum(sizes[place], sizes[q]) >= percent * np.maximum(sizes[place], sizes[q])) & (comp[place] != comp[q])
            if not fits.any():
                continue
            for m in trie.linked(tokens[q], fits):
                m = members[m]
                if comp[m] != comp[q]:
                    found.append((int(keys[q]), int(keys[m])))
                    comp[comp == comp[m]] = comp[q]
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _links_of_blocks(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """blocks(block, asks, stored, key, component) -> links."""
    whole = blocks.join(sets.select("key", "tokens"), "key")
    return whole.groupBy("block").applyInArrow(lambda table: _block_links(table, percent), "a long, b long")


def _shared(met: DataFrame, percent: int) -> DataFrame:
    """The rows whose shingle another class of fitting size has too; chain numbers the runs of fitting sizes of a shingle."""
    by_size = Window.partitionBy("shingle").orderBy("n", "key")
    marked = met.withColumns({
        "_first": F.coalesce(100 * F.lag("n").over(by_size) < percent * F.col("n"), F.lit(True)),
        "_last": F.coalesce(100 * F.col("n") < percent * F.lead("n").over(by_size), F.lit(True)),
    })
    chain = F.sum(F.col("_first").cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("chain", chain).where("NOT (_first AND _last)").drop("_first", "_last")


def class_links(docs: DataFrame, ngram: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes: doc_id, key, n of every row; components: id, component of the classes that link)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(_sketch(docs.select("text"), ngram))
    classes = cut(_classes(docs, ngram))
    # one shuffle brings the classes of a shingle together; those that nobody shares end here
    met = _shared(_prefixes(docs.select("text"), counts, ngram, percent).repartition("shingle").dropDuplicates(["shingle", "key"]), percent)
    for _ in range(2):  # a class that drops out may leave others with too few
        enough = met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where(f"_n >= ceil(n * {percent}L / 100) div 20 + 1").drop("_n", "chain")
        met = _shared(enough, percent)
    met = cut(met.select(F.xxhash64("shingle", "chain").alias("shingle"), "key", "n"))
    groups = met.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("key", "n")).alias("head"), F.sum(F.xxhash64("key") % 1_000_000_007).alias("s"), F.bit_xor(F.xxhash64("key")).alias("x"),
    ).where("size > 1")
    # shingles with the same members do the same work: one of them is enough
    one = groups.groupBy("size", "head", "s", "x").agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("alike"))
    one = one.select("shingle", "size", F.col("head.key").alias("leader"), F.col("head.n").alias("leader_n"), "alike")
    met = cut(met.join(one, "shingle"))
    # every class and those leaders of its groups with which it has enough of them in common
    fits = met.where(f"key <> leader AND 100L * least(n, leader_n) >= {percent}L * greatest(n, leader_n)").groupBy("leader", "key")
    stars = cut(fits.agg(F.sum("alike").alias("_n"), F.first(F.least("n", "leader_n")).alias("_least")).where("_n >= _least div 20 + 1").select("leader", "key"))
    candidates = met.where("size > 2 AND key <> leader").select("key").union(stars.select(F.explode(F.array("leader", "key")))).distinct()
    mask = spark.sparkContext.broadcast(_mask(candidates))
    once = _sets(docs.select("text"), counts, mask, ngram).groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = cut(once.join(candidates, "key", "left_semi"))
    sizes = stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    spread = stars.join(sizes, "leader").select(F.struct("leader", F.pmod(F.xxhash64("key"), "parts").alias("part")).alias("block"), F.lit(False).alias("asks"), F.lit(True).alias("stored"), "key", F.col("key").alias("component"))
    heads = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    heads = heads.select(F.struct("leader", "part").alias("block"), F.lit(True).alias("asks"), F.lit(False).alias("stored"), F.col("leader").alias("key"), F.col("leader").alias("component"))
    links = cut(_links_of_blocks(spread.unionByName(heads), sets, percent))
    linked = components(links)
    # groups that still hold several components, and pairs that no leader has compared; a pair that had too few groups with its leader
    # is among them under another leader
    labelled = met.where("size > 2").join(linked.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    open_ = labelled.groupBy("shingle").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("shingle")
    # shingles with one leader are done together, so that a class is sent once for all of them
    rows = labelled.where("key <> leader").join(open_, "shingle", "left_semi").select("leader", "key", "component", "n").distinct()
    weighed = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_n"))
    parts = weighed.where("_m > 1").select("leader", F.ceil(F.greatest(F.col("_m") / BLOCK, F.col("_n") / BLOCK_SHINGLES)).alias("parts"))
    rows = cut(rows.join(parts, "leader").drop("n").withColumn("mine", F.pmod(F.xxhash64("key"), "parts")))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    blocks = pairs.select(F.struct("leader", low.alias("i"), high.alias("j")).alias("block"), (F.col("mine") == low).alias("asks"), (F.col("mine") == high).alias("stored"), "key", "component")
    more = cut(_links_of_blocks(blocks, sets, percent))
    if more.limit(1).count():
        linked = components(links.union(more))
    return classes, linked


def linked_documents(docs: DataFrame, ngram: int = 3, percent: int = 90) -> DataFrame:
    """docs -> doc_id, n_shingles, component_id (smallest doc_id reachable by links, the document itself included), one row per row.

    Null, empty and blank texts have an empty set and link with nothing, not even each other; texts of fewer words than the n-gram are
    one shingle.  Repeated rows link.  A null doc_id counts as larger than any other.  Other columns are not read; an empty table gives an
    empty result.
    """
    classes, linked = class_links(docs, ngram, percent)
    ids = linked.select(F.col("id").alias("key"), "component")
    named = classes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("_id")).join(ids, "key", "left").withColumn("_c", F.coalesce("component", "key"))
    smallest = named.groupBy("_c").agg(F.min("_id").alias("_smallest"))
    of_key = named.join(smallest, "_c").select(F.col("key").alias("_k"), "_smallest")
    out = classes.join(of_key, F.when(F.col("n") > 0, F.col("key")) == F.col("_k"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_smallest", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that link to a smaller doc_id, directly or through others.

    Texts without words all stay, and so do rows with a null doc_id and rows that agree in doc_id (exact dedup settles those).
    """
    gone = linked_documents(docs, ngram, percent).where("n_shingles > 0 AND component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
