"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Work on texts is CPU bound: a small input with fewer partitions than cores is dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Parquet table (a file or a folder of files); column pruning and filters reach the scan."""
    table = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return spread(table) if name in TEXT_TABLES else table


def load_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """Partitioned read of an operational table."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions
    )
    return reader.options(**options).load()
