"""Exact deduplication with keyed streaming state.

The state, one row per digest on disk (RocksDB) and without expiry, keeps the stable identifier that stays, its content locator and the
number of rows.  A digest that is met again is only a hit: the full bytes of both rows are compared before they count as equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, ensure_checkpoints

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk reserved in advance
}


def shared_path(spark: SparkSession, name: str) -> str:
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def seen_state(arrivals: DataFrame) -> DataFrame:
    """Streaming (or batch) arrivals(digest, id, locator) -> (digest, stay, locator, n): the state after each change.

    The largest identifier stays; null sorts before every other.
    """
    stays = F.max(F.struct(F.col("id").alias("stay"), F.col("locator")))
    return arrivals.groupBy("digest").agg(stays.alias("_s"), F.count(F.lit(1)).alias("n")).select("digest", "_s.stay", "_s.locator", "n")


def _streamed(slim: DataFrame, folder: str, files_per_trigger: int) -> DataFrame:
    """Runs the stream over the written arrivals and returns the last state of each digest."""
    spark = slim.sparkSession
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/arrivals")
    schema = seen_state(slim).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/changes/batch=-1")
    before = {name: spark.conf.get(name, None) for name in _STORE}
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    try:
        query = (
            seen_state(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/changes/batch={i}")).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    # counts only grow, so the row with the largest count is the last state of its digest
    changes = spark.read.schema(schema).parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max(F.struct("n", "stay", "locator")).alias("_m")).select("digest", "_m.stay", "_m.locator", "_m.n")


def _clashing(decided: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests under which a row's full bytes differ from those of the row that stays."""
    hits = decided.where((F.col("n") > 1) & ~F.col("kept")).select("digest", "id", "stay")
    texts = docs.select(F.col("digest").alias("_d"), F.col("id").alias("_i"), F.col("text"))
    own = hits.join(texts, (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i"))).select("digest", "stay", F.col("text").alias("own"))
    both = own.join(texts, (F.col("digest") == F.col("_d")) & F.col("stay").eqNullSafe(F.col("_i")))
    return both.where(F.col("own") != F.col("text")).select("digest").distinct()


def _decide(slim: DataFrame, state: DataFrame) -> DataFrame:
    joined = slim.join(state.select("digest", "stay", F.col("locator").alias("_at"), "n"), "digest")
    kept = F.col("id").eqNullSafe(F.col("stay")) & (F.col("locator") == F.col("_at"))
    return joined.select("digest", "id", "sha256", "stay", "n", kept.alias("kept"))


def dedup(
    docs: DataFrame, text: str = "text", identifier: str = "doc_id", digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256), files_per_trigger: int = 1000,
) -> DataFrame:
    """docs -> one row per row: id, stay (identifier of the row that stays), n (rows with the same text), kept, sha256, digest.

    Null texts count as empty, and empty texts are equal to each other.  Of equal texts the row with the largest identifier stays; of
    rows that also agree in the identifier, the one with the largest locator, so exactly one row of a group is kept.  Null identifiers
    come before all others.  Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(identifier).alias("id"), text_of.alias("text"), digest(text_of).cast("string").alias("digest"))
    folder = shared_path(spark, "exact-dedup")
    file = F.regexp_extract(F.input_file_name(), "[^/]*$", 0)
    locator = F.struct(file.alias("file"), F.monotonically_increasing_id().alias("position"))  # written once, so it is stable from there on
    arrivals = docs.select(digest(text_of).cast("string").alias("digest"), F.col(identifier).alias("id"), locator.alias("locator"), F.sha2(text_of, 256).alias("sha256"))
    arrivals.write.parquet(f"{folder}/arrivals")
    slim = spark.read.schema(arrivals.schema).parquet(f"{folder}/arrivals")
    try:
        state = _streamed(slim.select("digest", "id", "locator"), folder, files_per_trigger)
        decided = _decide(slim, state)
        clash = cut(_clashing(decided, rows))
        if clash.limit(1).count():  # two texts under one digest: the bytes themselves become the key
            apart = rows.join(clash, "digest", "left_semi")
            whole = apart.groupBy("digest", "text").agg(F.max("id").alias("stay"), F.count(F.lit(1)).alias("n"))
            loose = apart.withColumn("_at", F.monotonically_increasing_id()).join(whole.withColumnRenamed("digest", "_g"), "text").where(F.col("digest") == F.col("_g"))
            first = F.row_number().over(Window.partitionBy("digest", "text", "stay", "id").orderBy("_at")) == 1
            mended = loose.withColumn("_first", first).select("digest", "id", F.sha2("text", 256).alias("sha256"), "stay", "n", (F.col("id").eqNullSafe(F.col("stay")) & F.col("_first")).alias("kept"))
            decided = decided.join(clash, "digest", "left_anti").unionByName(mended)
        return cut(decided)
    finally:
        remove_path(spark, folder)


def kept_documents(docs: DataFrame, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, all columns; exactly one row of every group of equal texts."""
    stays = dedup(docs, text, identifier).where("kept").select(F.col("id").alias("_id"), F.col("sha256").alias("_sha"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(identifier).alias("_own"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("_key"))
    same = keyed.join(stays, (F.col("_key") == F.col("_sha")) & F.col("_own").eqNullSafe(F.col("_id")))
    one = same.withColumn("_rn", F.row_number().over(Window.partitionBy("_key", "_own").orderBy(F.lit(1))))
    return one.where("_rn = 1").select("_row.*")
