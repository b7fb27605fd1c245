"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks.  With weight w (a share of the active sources' integer weights), block j of a source is released at slot
floor(j / w) and due by slot ceil((j + 1) / w).  Earliest deadline first over the released blocks meets every deadline, so after any
number of slots each source has had its share to within less than one block.  The schedule repeats after as many slots as the weights
sum to, so one period is worked out once (its size is bounded by the weights, not by the data) and joined to all blocks.  When a source
runs out, the others go on with their weights; that is a new phase.  No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


PERIOD = 10_000  # largest sum of the integer weights
PLAN = pa.schema([("p2", pa.int32()), ("k2", pa.string()), ("j", pa.int64()), ("s", pa.int64()), ("r", pa.int64()), ("d", pa.int64())])


def integer_weights(weights: dict, period: int = PERIOD) -> dict:
    """Positive weights as integers in lowest terms whose sum is at most about `period`."""
    total = sum(weights.values())
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if all(float(v).is_integer() for v in weights.values()) and total <= period:
        out = {k: int(v) for k, v in weights.items()}
    else:
        out = {k: max(1, round(v / total * period)) for k, v in weights.items()}
    common = gcd(*out.values())
    return {k: v // common for k, v in out.items()}


def schedule(weights: dict) -> Iterator[tuple[object, int, int]]:
    """(source, block, slot) of the slots 0 to sum(weights) - 1, by earliest deadline first over released blocks; ties by name."""
    total = sum(weights.values())
    release = lambda j, w: j * total // w
    due = lambda j, w: -((-(j + 1) * total) // w)
    later = [(0, due(0, w), str(k), 0, k) for k, w in weights.items()]
    heapq.heapify(later)
    ready: list = []
    for slot in range(total):
        while later and later[0][0] <= slot:
            _, d, name, j, k = heapq.heappop(later)
            heapq.heappush(ready, (d, name, j, k))
        d, name, j, k = heapq.heappop(ready)
        if d <= slot:
            raise AssertionError("a deadline is missed")
        yield k, j, slot
        w = weights[k]
        heapq.heappush(later, (release(j + 1, w), due(j + 1, w), name, j + 1, k))


@dataclass
class Phase:
    first_slot: int
    first_block: dict  # per active source: its first block of the phase
    weights: dict
    slots: int
    planned: int  # slots of the period that the phase uses
    used_up: object  # the one source that gives its last block, in the last slot
    given: dict  # blocks of each source that gives any


def phases(blocks: dict, weights: dict) -> list[Phase]:
    """Blocks per source -> the phases; a phase ends with the slot in which a source gives its last block.

    As many phases as sources; the slots of a period are gone through once for each, and only as far as the phase goes.
    """
    done, slot, out = {k: 0 for k, n in blocks.items() if n}, 0, []
    while done:
        active = integer_weights({k: weights[k] for k in done})
        total = sum(active.values())
        last = {k: blocks[k] - done[k] - 1 for k in done}
        cycles = min(last[k] // w for k, w in active.items())  # whole periods before a source can run out
        ends = {k: last[k] % w for k, w in active.items() if last[k] // w == cycles}
        part: dict = {}
        for k, j, s in schedule(active):  # noqa: B007
            part[k] = j + 1
            if ends.get(k) == j:
                break
        given = {k: cycles * w + part.get(k, 0) for k, w in active.items() if cycles or k in part}
        n = cycles * total + s + 1
        out.append(Phase(slot, {k: done[k] for k in given}, active, n, total if cycles else n, k, given))
        slot += n
        done = {k: b for k, b in ((k, b + given.get(k, 0)) for k, b in done.items()) if b < blocks[k]}
    return out


def planned_slots(spark: SparkSession, found: list[Phase]) -> DataFrame:
    """(p2, k2, j, s, r, d): source, block, slot, release and deadline of the planned slots of every phase, worked out in tasks."""
    rows = [(p, phase.planned, [str(k) for k in phase.weights], list(phase.weights.values())) for p, phase in enumerate(found)]
    frame = spark.createDataFrame(rows, "p int, planned long, names array<string>, weights array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                weights = dict(zip(row["names"], row["weights"]))
                total = sum(weights.values())
                slots = list(islice(schedule(weights), row["planned"]))
                yield pa.RecordBatch.from_pylist(
                    [
                        {"p2": row["p"], "k2": k, "j": j, "s": s, "r": j * total // weights[k], "d": -((-(j + 1) * total) // weights[k])}
                        for k, j, s in slots
                    ],
                    PLAN,
                )

    return frame.mapInArrow(run, "p2 int, k2 string, j long, s long, r long, d long")


def numbered(rows: DataFrame, source: str, order: str, name: str, rows_per_bucket: int = 2_000) -> DataFrame:
    """rows with `name`, the number of each row within its source from 0, in the order of a hash of the order column.

    A source of any size is spread over buckets; only one count per (source, bucket) meets in a window.
    """
    buckets = max(1, rows.count() // rows_per_bucket)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = rows.groupBy(F.col(source).alias("_s"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_s", "_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(source, "_bucket").orderBy(order)) - 1)
    return ranked.join(starts, (F.col(source) == F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn(name, F.col("_start") + F.col("_rank"))


def mix(docs: DataFrame, weights: dict | None = None, block: int = 32, other: float = 1.0, source: str = "source", by: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """All rows of docs with source_block, slot (of the block in the mixture), slot_release and slot_deadline (within the phase, counted
    from the first slot of all) and mix_position, the row's place in the mixture.

    weights: target weight per source; sources that are not named get `other`, which is also every weight if weights is None.  A null
    source is a source of its own, called "".  Rows of a source are taken in the order of a hash of the columns `by`; repeated rows
    follow each other.  Columns of docs with the added names are replaced.  An empty table gives an empty result.  The sources' names and counts
    come to the driver, one row each, and one row for each phase and source that gives blocks in it; the schedule of a phase, at most
    PERIOD rows (or one for each source, if there are more), is made in a task.
    """
    spark = docs.sparkSession
    added = ["source_block", "slot", "slot_release", "slot_deadline", "mix_position"]
    docs = docs.drop(*added)
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    order = F.struct(F.xxhash64(*by), F.col(by[0]))
    rows = numbered(docs.select(F.struct(*docs.columns).alias("_row"), name.alias("_source"), order.alias("_order")), "_source", "_order", "_position")
    counts = {r["_n"]: r["c"] for r in docs.groupBy(name.alias("_n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    sizes = {k: -(-c // block) for k, c in counts.items()}
    target = {k: (weights or {}).get(k, other) for k in sizes}
    found = phases(sizes, target)
    spans, missing = [], 0  # missing: rows that the last blocks of sources used up in earlier phases are short of
    for p, phase in enumerate(found):
        total = sum(phase.weights.values())
        for k, n in phase.given.items():
            first = phase.first_block[k]
            spans.append((p, k, first, first + n, phase.weights[k], total, phase.first_slot, missing))
        missing += -counts[phase.used_up] % block
    span_df = spark.createDataFrame(spans, "p int, k string, first long, until long, w long, total long, slot0 long, missing long")
    few = sum(phase.planned for phase in found) <= 20 * PERIOD  # else the schedule is shuffled as well
    plan_df = planned_slots(spark, found).hint("broadcast" if few else "merge")
    out = rows.withColumn("source_block", F.floor(F.col("_position") / block))
    out = out.join(span_df, (F.col("_source") == F.col("k")) & (F.col("source_block") >= F.col("first")) & (F.col("source_block") < F.col("until")))
    local = F.col("source_block") - F.col("first")
    out = out.withColumns({"_cycle": F.floor(local / F.col("w")), "_j": local % F.col("w")})
    out = out.join(plan_df, (F.col("p") == F.col("p2")) & (F.col("_source") == F.col("k2")) & (F.col("_j") == F.col("j")))
    base = F.col("slot0") + F.col("_cycle") * F.col("total")
    out = out.withColumns({"slot": base + F.col("s"), "slot_release": base + F.col("r"), "slot_deadline": base + F.col("d")})
    # slots before this one hold full blocks except the last blocks of sources that are used up, and each of these ends a phase
    out = out.withColumn("mix_position", F.col("slot") * block + F.col("_position") % block - F.col("missing"))
    return out.select("_row.*", *added)
