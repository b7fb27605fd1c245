"""Scores, total orders, neighbours, versions and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.core import col, map_lookup, nulls_to, text
from ..functions.dates import parse_cn_date, ts
from .filters import cover_score
from .ordered import neighbours, row_numbers, top_per_key


def hot_score(weights=None) -> Column:
    """On a frame from joins.with_engagement."""
    w = weights or V.HOT_WEIGHTS
    return (
        F.when(F.col("pinned"), w["pinned"]).otherwise(0) + F.col("importance") * w["importance"] + F.col("views") * w["views"]
        + F.col("likes") * w["likes"] + F.col("favorites") * w["favorites"] + F.col("reminders") * w["reminders"]
    ).cast("bigint")


BUSINESS_COLUMNS = ("pinned", "hot_score", "importance", "published_at", "id")


def business_order() -> list[Column]:
    return [F.desc(c) for c in BUSINESS_COLUMNS]


def neighbor_items(items: DataFrame, same_category: bool = True) -> DataFrame:
    """Previous and next id of every item in business order.

    The neighbour inside the category is preferred per direction, the global one
    is the fallback; null at the ends.
    """
    slim = items.select(*BUSINESS_COLUMNS, "category")
    out = neighbours(slim, [], business_order(), "id", "g_prev", "g_next")
    if not same_category:
        return out.select("id", F.col("g_prev").alias("previous_id"), F.col("g_next").alias("next_id"))
    inner = neighbours(slim, ["category"], business_order(), "id", "c_prev", "c_next").select("id", "c_prev", "c_next")
    return out.select("id", "g_prev", "g_next").join(inner, "id").select(
        "id", F.coalesce("c_prev", "g_prev").alias("previous_id"), F.coalesce("c_next", "g_next").alias("next_id")
    )


def importance_score(as_of, weights=None, default: int = V.DEFAULT_CATEGORY_WEIGHT) -> Column:
    """importance + pin + category weight + freshness (30 days minus the age in days) - 12 when read."""
    age_days = (
        F.unix_micros(ts(as_of).cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))
    ) / F.lit(86400000000.0)
    fresh = F.greatest(F.lit(0.0), F.lit(30.0) - F.greatest(F.lit(0.0), age_days))
    return (
        nulls_to(F.col("importance"), 0) + F.when(F.col("pinned"), 100).otherwise(0)
        + map_lookup(F.col("category"), weights or V.CATEGORY_WEIGHTS, default) + fresh
        - F.when(nulls_to(F.col("is_read"), False), 12).otherwise(0)
    )


def home_feed(items: DataFrame, preferred: list[str], region_code: str, as_of, n: int = 12, weights=None) -> DataFrame:
    """The featured item (rank 1) and the next n by importance, preference, deadline, locality and cover."""
    rank = (
        importance_score(as_of, weights)
        + F.when(F.col("category").isin(preferred), 12).otherwise(0)
        + F.when(F.col("deadline_at").isNotNull(), 18).otherwise(0)
        + F.when(nulls_to(F.col("is_local"), False) | nulls_to(F.col("region_code") == region_code, False), 16).otherwise(0)
        + cover_score()
    )
    top = items.withColumn("feed_score", rank).orderBy(F.desc("feed_score"), F.desc("id")).limit(n + 1)
    # at most n + 1 rows are left
    from pyspark.sql import Window

    return top.withColumn("feed_rank", F.row_number().over(Window.orderBy(F.desc("feed_score"), F.desc("id")))).withColumn(
        "featured", F.col("feed_rank") == 1
    )


def assign_versions(docs: DataFrame, root: str = "root_id", order: str = "id", base: DataFrame | None = None) -> DataFrame:
    """Version numbers along each root: highest existing version plus the place in the batch, with the previous id.

    base holds (root, max_version, last_id) of what is already stored.
    """
    numbered = row_numbers(docs.select(root, order), [root], [F.col(order)], "place")
    linked = neighbours(docs.select(root, order), [root], [F.col(order)], order, "prev_in_batch", "next_in_batch")
    out = numbered.join(linked, [root, order])
    if base is not None:
        out = out.join(base.select(root, "max_version", "last_id"), root, "left")
    else:
        out = out.withColumns({"max_version": F.lit(0).cast("bigint"), "last_id": F.lit(None).cast("bigint")})
    versions = out.select(
        order, (nulls_to(F.col("max_version"), 0) + F.col("place")).alias("version_no"),
        F.coalesce("prev_in_batch", "last_id").alias("previous_version_id"),
        F.col("next_in_batch").isNotNull().alias("superseded"),
    )
    return docs.join(versions, order)


def rank_images(images: DataFrame) -> DataFrame:
    """priority_rank follows the source order, list_rank the relevance; best marks the first most relevant one."""
    placed = row_numbers(images, ["document_id"], [F.col("pos"), F.col("id")], "priority_rank")
    listed = row_numbers(placed, ["document_id"], [F.desc("relevance_score"), F.col("pos"), F.col("id")], "list_rank")
    return listed.withColumn("best", F.col("list_rank") == 1)


def auto_approve(images: DataFrame, policies: DataFrame) -> DataFrame:
    """The first pending image of each document whose source policy allows it."""
    allowed = policies.where(
        "auto_approve_images and image_cache_allowed and image_policy_reviewed_at is not null and trim(coalesce(image_usage_basis,'')) <> ''"
    ).select("document_id")
    pending = images.where("review_status = 'PENDING'").join(allowed, "document_id", "left_semi")
    return top_per_key(pending, ["document_id"], [F.desc("relevance_score"), F.col("priority_rank"), F.col("id")], 1)


def history(events: DataFrame, n: int = 50) -> DataFrame:
    """Latest visit of each item, newest n per user."""
    last = events.groupBy("user_id", "item_id").agg(F.max("ts").alias("visited_at"))
    return top_per_key(last, ["user_id"], [F.desc("visited_at"), F.desc("item_id")], n, "history_rank")


def lifecycle(fields: DataFrame) -> DataFrame:
    """effective_from, deadline_at and expires_at of each document from its first dated fields."""
    filled = fields.where(text("field_value") != "")

    def first(kind):
        return F.min_by(F.when(F.col("field_type") == kind, F.col("field_value")), F.when(F.col("field_type") == kind, F.col("id")))

    dates = filled.groupBy("document_id").agg(first("START_DATE").alias("s"), first("END_DATE").alias("e"))
    start, end = parse_cn_date("s"), parse_cn_date("e")
    return dates.select(
        "document_id", start.cast("timestamp_ntz").alias("effective_from"),
        (end.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(23), mins=F.lit(59), secs=F.lit(59))).alias("deadline_at"),
        F.date_add(end, 1).cast("timestamp_ntz").alias("expires_at"),
    )


def evidence(items: DataFrame, region_code: str) -> DataFrame:
    """Own region first, then newest."""
    return items.orderBy(F.when(col("region_code") == region_code, 0).otherwise(1), F.desc("published_at"), F.desc("id"))
