"""JSON fixture scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.core import is_blank

FIELDS = ["id", "title", "sourceName", "sourceType", "sourceUrl", "publisher", "publishedAt", "body", "category"]


def checked_fixture(raw: DataFrame) -> DataFrame:
    """All nine fields are mandatory: the row that lacks one fails naming the field."""
    out = raw
    for f in FIELDS:
        message = F.lit(f"fixture field missing: {f}")
        out = out.withColumn(f, F.when(is_blank(f), F.raise_error(message)).otherwise(F.col(f)))
    return out.select(
        *[F.col(f) for f in FIELDS if f != "publishedAt"],
        F.col("publishedAt").cast("date").cast("timestamp_ntz").alias("publishedAt"),
    )


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Array of objects, pretty-printed JSON allowed."""
    schema = ", ".join(f"`{f}` string" for f in FIELDS)
    return checked_fixture(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path))
