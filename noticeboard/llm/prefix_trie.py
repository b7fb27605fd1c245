"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

Nodes: a running exclusive-or of 64-bit pairs hash(depth, role, text) names every prefix, so prefixes of conversations of any length are
known without a task that holds one, and the parent of a node is its name without the last turn's hash.

Contraction: in every round of joins all leaves are raked (their totals go to their parents), then unary chains are compressed: a node with
one child leaves when it is a local minimum along its chain by (trailing zeros of its depth, hash of its depth), which halves an intact
chain each time; its child is hung one up, with what the node would have added kept on that edge.  A tree of n nodes is gone after about
log2 n rounds, whatever its depth.  Expansion: a node that was compressed away has the total of its child plus a constant; pointers from
these nodes are doubled until they end in raked ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import Rounds, in_blocks, in_order, over_blocks
from .common import cut

CHUNK = 4096  # identifiers hashed together
NAME = ["p1", "p2"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(c, pos, item, words): the turns of each conversation numbered from 1; item names role and text."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("item"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("item")]
    return in_order(slim, ["c"], order, sums={"pos": F.lit(1).cast("long")}).withColumn("pos", F.col("pos") + 1).drop("turn")


def rebuilt(rows: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """turn_rows -> (c, part, pos, item, words): the first h turns of conversation c - c % stride, then c's own turns after its first h,
    h = crc32(c) % heads.  A conversation without any turn left has one row of part null."""
    first = rows.where((F.col("c") % stride == 0) & (F.col("pos") < heads)).groupBy(F.col("c").alias("r")).agg(F.collect_list(F.struct("pos", "item", "words")).alias("head"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    convs = rows.groupBy("c").agg(F.max("pos").alias("n")).withColumns({"h": h, "r": F.col("c") - F.col("c") % stride})
    convs = convs.join(first, "r", "left").withColumn("head", F.filter("head", lambda x: x["pos"] <= F.col("h")))
    taken = convs.where(F.size("head") > 0).select("c", F.lit(0).alias("part"), F.explode("head").alias("t")).select("c", "part", "t.*")
    bare = convs.where((F.coalesce(F.size("head"), F.lit(0)) <= 0) & (F.col("n") <= F.col("h"))).select("c", F.lit(None).cast("int").alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("words"))
    own = rows.where(F.col("pos") > h).select("c", F.lit(1).alias("part"), "pos", "item", "words")
    return taken.unionByName(own).unionByName(bare)


def prefixes(turns: DataFrame) -> DataFrame:
    """rebuilt -> (c, depth, p1, p2, q1, q2, words, ends): one row per conversation and prefix; q is the parent's name, the root's is (0, 0)."""
    order = [F.col("part"), F.col("pos")]
    real = F.col("part").isNotNull()
    blocks = in_blocks(turns, {"_block": ["c"]}, order)
    deep = over_blocks(blocks, ["c"], order, sums={"above": real.cast("long")}).withColumn("depth", F.col("above") + real.cast("long"))
    hashes = {"x1": F.xxhash64("depth", "item"), "x2": F.xxhash64("item", "depth")}
    deep = deep.withColumns({n: F.when(real, h).otherwise(F.lit(0)) for n, h in hashes.items()})
    named = over_blocks(deep, ["c"], order, xors={"q1": F.col("x1"), "q2": F.col("x2")})
    return named.select("c", "depth", F.col("q1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("q2").bitwiseXOR(F.col("x2")).alias("p2"), "q1", "q2", "words")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """(p1, p2, q1, q2, depth, conv_id, n_convs, own): the nodes of the trie; the root has no parent."""
    node = paths.where("depth > 0").groupBy(*NAME).agg(
        F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("depth").alias("depth"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"),
    )
    top = paths.where("depth <= 1").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = top.select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), none.alias("q1"), none.alias("q2"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    return node.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words")


def _priority(depth: Column) -> Column:
    """Order in which the nodes of a chain leave: by the trailing zeros of the depth, ties by a hash of it; the root never does."""
    zeros = F.when(depth == 0, 64).otherwise(F.bit_count(depth.bitwiseAND(-depth) - 1))
    return F.struct(zeros.alias("z"), F.xxhash64(depth).alias("h"), depth.alias("d"))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """nodes(p1, p2, q1, q2, depth, own) of a tree -> (p1, p2, n_children, n_leaves, saved): totals of every subtree."""
    kids = nodes.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("kids"))
    tree = nodes.select(*NAME, "q1", "q2", "depth", "own").join(kids, NAME, "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    rounds = Rounds(nodes.sparkSession)
    counted = rounds.put(tree)
    # active: parent and its depth, children left, totals so far (leaves, saved), what the edge to the parent adds (el, es)
    zero = F.lit(0).cast("long")
    active = counted.select(*NAME, "q1", "q2", "depth", (F.col("depth") - 1).alias("up"), "kids", (F.col("kids") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"), zero.alias("el"), zero.alias("es"))
    finished = gone = None
    while True:
        # rake: leaves report to their parents; what else hangs there matters only where it is a single node
        leaf = F.col("kids") == 0
        told = active.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
            F.count_if(leaf).alias("raked"), F.sum(F.when(leaf, F.col("leaves") + F.col("el")).otherwise(0)).alias("l"), F.sum(F.when(leaf, F.col("saved") + F.col("es")).otherwise(0)).alias("s"),
            F.min(F.when(~leaf, F.struct("p1", "p2", "depth", "el", "es"))).alias("child"),
        )
        merged = active.join(told, NAME, "left")
        state = merged.select(
            *NAME, "q1", "q2", "depth", "up", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("left"), leaf.alias("leaf"),
            (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), "el", "es", "child",
        )
        # compress: local minima of their chains
        me, above, below = _priority(F.col("depth")), _priority(F.col("up")), _priority(F.col("child.depth"))
        leaves_chain = ~F.col("leaf") & (F.col("left") == 1) & F.col("q1").isNotNull() & (me < above) & (me < below)
        state = rounds.put(state.withColumn("out", F.coalesce(leaves_chain, F.lit(False))))
        raked = state.where("leaf").select(*NAME, F.lit(None).cast("long").alias("t1"), F.lit(None).cast("long").alias("t2"), F.col("leaves").alias("n_leaves"), "saved")
        passed = state.where("out").select(*NAME, F.col("child.p1").alias("t1"), F.col("child.p2").alias("t2"), (F.col("leaves") + F.col("child.el")).alias("n_leaves"), (F.col("saved") + F.col("child.es")).alias("saved"))
        finished = raked if finished is None else finished.unionByName(raked)
        gone = passed if gone is None else gone.unionByName(passed)
        rest = state.where("NOT leaf AND NOT out")
        if rest.isEmpty():
            break
        moved = state.where("out").select(
            F.col("child.p1").alias("p1"), F.col("child.p2").alias("p2"), F.struct("q1", "q2", "up", (F.col("leaves") + F.col("el")).alias("l"), (F.col("saved") + F.col("es")).alias("s")).alias("m")
        )
        to = F.col("m").isNotNull()
        active = rounds.put(rest.join(moved, NAME, "left").select(
            *NAME, *[F.when(to, F.col(f"m.{n}")).otherwise(F.col(n)).alias(n) for n in ("q1", "q2")], "depth", F.when(to, F.col("m.up")).otherwise(F.col("up")).alias("up"),
            F.col("left").alias("kids"), "leaves", "saved", (F.col("el") + F.coalesce("m.l", F.lit(0))).alias("el"), (F.col("es") + F.coalesce("m.s", F.lit(0))).alias("es"),
        ))
    finished, gone = rounds.put(finished), rounds.put(gone)
    # expansion: pointers of compressed nodes are doubled until they end in finished ones
    while not gone.isEmpty():
        known = finished.unionByName(gone).select(F.col("p1").alias("t1"), F.col("p2").alias("t2"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
        step = rounds.put(gone.join(known, ["t1", "t2"]).select(*NAME, F.col("u1").alias("t1"), F.col("u2").alias("t2"), (F.col("n_leaves") + F.col("l")).alias("n_leaves"), (F.col("saved") + F.col("s")).alias("saved")))
        finished, gone = finished.unionByName(step.where("t1 IS NULL")), step.where("t1 IS NOT NULL")
    return rounds.close(counted.select(*NAME, F.col("kids").alias("n_children")).join(finished.select(*NAME, "n_leaves", "saved"), NAME))


def end_digests(paths: DataFrame) -> DataFrame:
    """paths (the last row of each conversation) -> (p1, p2, ends_sha256): SHA-256 of the conversations that end at a node, in order of
    number, comma-joined.  Numbers are joined by range partitions into pieces; a digest then reads the pieces of its node one after another."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, name, held = TaskContext.get().partitionId(), 0, None, []
        schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("block", pa.int64()), ("piece", pa.int64()), ("ids", pa.string())])

        def flush(ready):
            return pa.RecordBatch.from_pylist(ready, schema)

        ready: list[dict] = []
        for batch in batches:
            for p1, p2, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and ((p1, p2) != name or len(held) == CHUNK):
                    ready.append({"p1": name[0], "p2": name[1], "block": block, "piece": n, "ids": ",".join(held)})
                    n, held = n + 1, []
                name = (p1, p2)
                held.append(str(c))
            yield flush(ready)
            ready = []
        if held:
            yield flush([{"p1": name[0], "p2": name[1], "block": block, "piece": n, "ids": ",".join(held)}])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            ready = []
            for p1, p2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (p1, p2) != name:
                    if name:
                        ready.append({"p1": name[0], "p2": name[1], "ends_sha256": state.hexdigest()})
                    name, state = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pylist(ready, schema)
        if name:
            yield pa.RecordBatch.from_pylist([{"p1": name[0], "p2": name[1], "ends_sha256": state.hexdigest()}], schema)

    ranged = paths.select(*NAME, "c").repartitionByRange(*NAME, "c").sortWithinPartitions(*NAME, "c")
    joined = ranged.mapInArrow(pieces, "p1 long, p2 long, block long, piece long, ids string")
    return joined.repartition(*NAME).sortWithinPartitions(*NAME, "block", "piece").select(*NAME, "ids").mapInArrow(digests, "p1 long, p2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row per node of the trie of the rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, equal turns by the MD5 of role and text; repeated rows are turns of their own.  Null role or text
    is empty.  Rows with a null conv_id belong to no conversation and are left out.  Other columns are not read; an empty table gives an
    empty result, without a root.
    """
    rows = cut(turn_rows(conversations))
    paths = cut(prefixes(rebuilt(rows, stride, heads)))
    nodes = cut(trie_nodes(paths))
    totals = subtree_totals(nodes)
    # a conversation ends where its depth is largest; depth 0 stands for a conversation without turns
    last = paths.groupBy("c").agg(F.max_by(F.struct(*NAME), "depth").alias("at")).select("c", "at.*")
    ends = end_digests(last)
    parent = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, NAME).join(parent, ["q1", "q2"], "left").join(ends, NAME, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
