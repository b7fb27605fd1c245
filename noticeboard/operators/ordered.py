"""Exact order-dependent columns over groups of any size.

``Window.orderBy`` without (or with a hot) partition key sends the whole group to
one task.  These helpers range-partition the rows by (keys, order) into blocks, so
that a group spreads over many tasks, solve each block locally and stitch the
blocks with one small aggregate per (block, key).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on local masters where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="noticeboard-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """A reliable, eager checkpoint: cuts lineage and survives lost executors.

    Its files lie in the shared folder; with spark.cleaner.referenceTracking.cleanCheckpoints
    the engine removes them when nothing refers to them any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The state of an iteration, written to the shared folder after every round and read back.

    A checkpoint carries the size estimate of its plan on, and joins of the state with itself multiply it
    in every round; what is read back has the size of its files.  close removes all files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, result: DataFrame | None = None) -> DataFrame | None:
        """Removes the files; a result that still reads them is materialised first."""
        out = None if result is None else materialise(result)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return out


def in_blocks(df: DataFrame, groups: dict[str, list[str]], order: list[Column]) -> DataFrame:
    """Adds one block number column per name: rows range-partitioned by (keys, order).

    A group of any size spreads over many blocks, and blocks of a group follow its order.
    """
    for name, keys in groups.items():
        ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
        df = materialise(ranged.withColumn(name, F.spark_partition_id()))
    return df


def over_blocks(
    df: DataFrame, keys: list[str], order: list[Column], block: str = "_block", sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None,
    before: dict[str, str] | None = None, after: dict[str, str] | None = None,
) -> DataFrame:
    """Adds, from one sort of the rows within their blocks (see in_blocks, same keys and order; df must be stable):

    sums, xors: name -> value, folded over all earlier rows of the group (exclusive, 0 for the first);
    before, after: name -> column, its value in the previous or next row of the group (null at the ends).

    Only a group that goes on from one block to the next needs anything from outside its block, so what
    is passed on is one row per block, which is broadcast: as many rows as there are partitions.
    order must be a total order within the group.
    """
    sums, xors, before, after = sums or {}, xors or {}, before or {}, after or {}
    folds = [(n, v, F.sum) for n, v in sums.items()] + [(n, v, F.bit_xor) for n, v in xors.items()]
    within = Window.partitionBy(block, *keys).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(block).orderBy(*keys, *order)
    local = df.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v, _ in folds})
    local = local.withColumns({
        **{f"_i_{n}": fold(f"_v_{n}").over(so_far) for n, _, fold in folds},
        **{f"_b_{n}": F.lag(F.struct(F.col(c).alias("v"))).over(within) for n, c in before.items()},
        **{f"_a_{n}": F.lead(F.struct(F.col(c).alias("v"))).over(within) for n, c in after.items()},
        "_first": F.lag(F.lit(1)).over(whole).isNull(), "_last": F.lead(F.lit(1)).over(whole).isNull(),
    })
    group = F.struct(F.lit(0).alias("_"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    head = F.struct(group.alias("k"), *[F.struct(F.col(c).alias("v")).alias(f"a_{n}") for n, c in after.items()])
    tail = F.struct(group.alias("k"), *[F.col(f"_i_{n}").alias(f"i_{n}") for n, _, _ in folds], *[F.struct(F.col(c).alias("v")).alias(f"b_{n}") for n, c in before.items()])
    ends = local.where("_first OR _last").groupBy(block).agg(F.max_by(head, "_first").alias("_h"), F.max_by(tail, "_last").alias("_t"))
    line, same = Window.partitionBy().orderBy(block), Window.partitionBy("_t.k").orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = ends.withColumns({f"_c_{n}": fold(F.col(f"_t.i_{n}")).over(same) for n, _, fold in folds})
    passed = total.select(
        F.col(block).alias("_at"), F.lag("_t.k").over(line).alias("_pk"), F.lead("_h.k").over(line).alias("_nk"),
        *[F.lag(f"_c_{n}").over(line).alias(f"_p_{n}") for n, _, _ in folds], *[F.lag(f"_t.b_{n}").over(line).alias(f"_pb_{n}") for n in before],
        *[F.lead(f"_h.a_{n}").over(line).alias(f"_na_{n}") for n in after],
    )
    out = local.join(F.broadcast(passed), F.col(block) == F.col("_at"))
    from_before, from_after = group.eqNullSafe(F.col("_pk")), group.eqNullSafe(F.col("_nk"))

    def shifted(name, fold):
        more = F.when(from_before, F.col(f"_p_{name}")).otherwise(F.lit(0))
        if fold is F.sum:
            return F.col(f"_i_{name}") - F.col(f"_v_{name}") + more
        return F.col(f"_i_{name}").bitwiseXOR(F.col(f"_v_{name}")).bitwiseXOR(more.cast("bigint"))

    return out.select(
        *df.columns, *[shifted(n, fold).alias(n) for n, _, fold in folds],
        *[F.coalesce(F.col(f"_b_{n}"), F.when(from_before, F.col(f"_pb_{n}")))["v"].alias(n) for n in before],
        *[F.coalesce(F.col(f"_a_{n}"), F.when(from_after, F.col(f"_na_{n}")))["v"].alias(n) for n in after],
    )


def in_order(df: DataFrame, keys: list[str], order: list[Column], **wanted) -> DataFrame:
    """over_blocks for rows that are not in blocks yet: one exchange by range, one sort."""
    return over_blocks(in_blocks(df, {"_block": keys}, order), keys, order, **wanted).drop("_block")


def running_totals(df: DataFrame, keys: list[str], order: list[Column], **values: Column) -> DataFrame:
    """Adds, per name, the sum of the value over all earlier rows of the group (exclusive).

    order must be a total order within the group.
    """
    return in_order(df, keys, order, sums=values)


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """row_number() for groups of any size."""
    out = running_totals(df, keys, order, **{name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) + 1)


def neighbours(df: DataFrame, keys: list[str], order: list[Column], value: str, before: str, after: str) -> DataFrame:
    """lag/lead of one column for groups of any size."""
    return in_order(df, keys, order, before={before: value}, after={after: value})


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each group.

    Spark turns the filter into a WindowGroupLimit before the shuffle, so a hot
    group contributes at most k rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)
