"""Sinks and stored JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import col, text


def append_events(events: DataFrame, path: str) -> None:
    """Append accepted events, one folder per day."""
    events.withColumn("event_date", F.col("created_at").cast("date")).write.mode("append").partitionBy("event_date").parquet(path)


def snapshot_row(metrics: DataFrame, day) -> DataFrame:
    """The metrics of one day as a JSON row."""
    return metrics.select(F.lit(day).cast("date").alias("snapshot_date"), F.to_json(F.struct("*")).alias("metrics_json"))


def write_snapshot(metrics: DataFrame, day, path: str) -> None:
    """One row per date: a rerun replaces the folder of the same day only."""
    (
        snapshot_row(metrics, day).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date").parquet(path)
    )


def write_documents(documents: DataFrame, path: str, domain: str = "source_domain") -> None:
    """Append imported documents; a large domain may be written by many tasks."""
    documents.write.mode("append").partitionBy(domain).parquet(path)


def rows_to_insert(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target does not have; one per key (smallest row)."""
    fresh = rows.join(target.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else fresh.distinct()


def insert_if_absent(rows: DataFrame, target: DataFrame, keys: list[str], path: str) -> None:
    rows_to_insert(rows, target, keys).write.mode("append").parquet(path)


def valid_json(c) -> Column:
    """The text when it is JSON, else null."""
    return F.when(F.try_parse_json(col(c)).isNotNull(), col(c))


def decode_generated(content: DataFrame, doc: str = "document_id") -> DataFrame:
    """(document, content_type, value): JSON when valid, else the plain text; SUMMARY also yields ACCESSIBLE_TEXT.

    The latest row (greatest id) of a type wins.
    """
    latest = content.groupBy(doc, "content_type").agg(F.max_by(F.struct("content_json", "plain_text"), "id").alias("c")).select(doc, "content_type", "c.*")
    value = F.coalesce(valid_json("content_json"), F.col("plain_text"))
    main = latest.select(doc, "content_type", value.alias("value"))
    spoken = latest.where("content_type = 'SUMMARY' and plain_text is not null and (content_json is null or try_parse_json(content_json) is not null)")
    return main.unionByName(spoken.select(doc, F.lit("ACCESSIBLE_TEXT").alias("content_type"), F.col("plain_text").alias("value")))


def benefits(c) -> Column:
    """List of benefits; an invalid document is an empty list."""
    return F.coalesce(F.from_json(text(c), "array<string>"), F.array().cast("array<string>"))
