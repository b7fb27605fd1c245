"""Filters, selections and row-level labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.core import any_of, col, has_any, is_blank, nulls_to, strip, text
from ..functions.dates import candidate_date, ts
from ..functions.urls import host, host_allowed
from .ordered import top_per_key

# ------------------------------------------------------------- public items --


def visible(items: DataFrame, as_of, expiry: bool = True) -> DataFrame:
    """Published and (optionally) not expired; the expiry bound is inclusive."""
    out = items.where(F.col("status") == "PUBLISHED")
    return out.where(F.col("expires_at").isNull() | (F.col("expires_at") >= ts(as_of))) if expiry else out


def search(items: DataFrame, keyword: str, columns=("title", "summary", "category")) -> DataFrame:
    """Case-sensitive LIKE %keyword%; % and _ of the keyword act as wildcards."""
    pattern = f"%{keyword.strip()}%"
    return items.where(any_of(F.col(c).like(pattern) for c in columns))


def by_channel(items: DataFrame, channel: str, aliases=None, column: str = "category", all_channel: str = V.RECOMMEND_CHANNEL) -> DataFrame:
    aliases = V.CHANNEL_ALIASES if aliases is None else aliases
    return items if channel == all_channel else items.where(F.col(column).isin(aliases.get(channel, [channel])))


def content_kind(kind="content_kind", slug="slug", category="category", news_categories=None) -> Column:
    """news or guide: reviewed kind, else slug prefix, else category list."""
    return (
        F.when(~is_blank(kind), F.when(col(kind) == "SERVICE_NOTICE", "guide").otherwise("news"))
        .when(F.startswith(text(slug), F.lit("news-")), "news")
        .when(col(category).isin(news_categories or V.NEWS_CATEGORIES), "news")
        .otherwise("guide")
    )


def cover_score(url="cover_image_url", kind="cover_image_type", scores=None) -> Column:
    from ..functions.core import map_lookup

    return F.when(is_blank(url), F.lit(0)).otherwise(map_lookup(text(kind), scores or V.COVER_SCORES, 0))


def card_kind(items: DataFrame, activity: str = V.ACTIVITY_TEXT, alert: str = V.ALERT_TITLE, news_categories=None) -> Column:
    """image, activity, service, alert or text."""
    joined = F.concat_ws(" ", text("title"), text("summary"), text("category"))
    return (
        F.when(cover_score() > 0, "image")
        .when(F.rlike(joined, F.lit(activity)), "activity")
        .when(content_kind(news_categories=news_categories) == "guide", "service")
        .when(F.rlike(text("title"), F.lit(alert)), "alert")
        .otherwise("text")
    )


def by_service_kind(items: DataFrame, kind: str, patterns=None, news_categories=None) -> DataFrame:
    """Items of a service page; guides also take every item of kind guide."""
    pattern = (patterns or V.SERVICE_KIND_PATTERNS)[kind]
    hit = F.rlike(F.concat(text("title"), text("summary"), text("category")), F.lit(pattern))
    if kind == "guides":
        hit = hit | (content_kind(news_categories=news_categories) == "guide")
    return items.where(hit)


def directory_by_kind(directory: DataFrame, kind: str, patterns=None) -> DataFrame:
    """Service directory of a page; contacts need a phone."""
    if kind == "contacts":
        return directory.where(~is_blank("phone"))
    joined = F.concat(text("name"), text("description"), text("service_type"))
    return directory.where(F.rlike(joined, F.lit((patterns or V.SERVICE_KIND_PATTERNS)[kind])))


def facet(items: DataFrame, query: str = "", kind: str | None = None, institution: str | None = None, categories=None) -> DataFrame:
    out = items.where(F.col("category").isin(categories or V.SERVICE_CATEGORIES))
    if query:
        out = out.where(F.contains(F.concat(text("title"), text("summary")), F.lit(query)))
    if kind is not None:
        out = out.where(F.col("category") == kind)
    if institution is not None:
        out = out.where(F.col("source_name") == institution)
    return out


def facet_values(items: DataFrame, categories=None) -> DataFrame:
    return items.where(F.col("category").isin(categories or V.SERVICE_CATEGORIES)).select("source_name").distinct()


def audit_titles(items: DataFrame, pattern: str = V.TEST_TITLE) -> DataFrame:
    """Published titles that look like test content first."""
    check = F.when(F.rlike(text("title"), F.lit(pattern)), "SUSPICIOUS").otherwise("ok")
    return (
        items.where(F.col("status") == "PUBLISHED").withColumn("title_check", check)
        .orderBy(F.desc("title_check"), "document_id")
    )


def reminders(reminders_df: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """Reminders with their items, split into upcoming and ended."""
    joined = reminders_df.join(
        items.select(F.col("id").alias("published_item_id"), "slug", "title", "category", F.col("status").alias("content_status")),
        "published_item_id",
    )
    return joined.withColumn("reminder_group", F.when(F.col("remind_at") >= ts(as_of), "upcoming").otherwise("ended"))


# ------------------------------------------------------------------ sources --


def filter_candidates(
    candidates: DataFrame, as_of_date, include=(), exclude=(), recent_days: int = 7, max_articles: int | None = None,
    only_unimported: bool = False, by=("source_id",),
) -> DataFrame:
    """Keyword and recency filter; with max_articles, the first so many of each source (by) in list order (pos).

    An empty `by` takes all rows as the list of one discovery call.
    """
    if recent_days not in V.RECENT_DAYS:
        raise ValueError(f"recent_days must be one of {V.RECENT_DAYS}")
    if max_articles is not None and max_articles < 1:
        raise ValueError("max_articles must be at least 1")
    searchable = F.lower(F.concat(strip("title"), F.lit(" "), strip("canonical_url")))
    out = candidates
    if include:
        out = out.where(has_any(searchable, include))
    if exclude:
        out = out.where(~has_any(searchable, exclude))
    published = candidate_date("published_time")
    earliest = F.date_sub(F.lit(as_of_date).cast("date"), recent_days)
    out = out.where(published.isNull() | (published >= earliest))
    if only_unimported:
        out = out.where(~nulls_to(F.col("imported"), False))
    if max_articles is None:
        return out
    return top_per_key(out, list(by), [F.col("pos")], max_articles) if by else out.orderBy("pos").limit(max_articles)


def gate_hosts(candidates: DataFrame, registry: DataFrame, per_source: int = 100) -> tuple[DataFrame, DataFrame]:
    """Host allow-list: (kept rows, one summary row per source with the filtered count and first five domains)."""
    usable = candidates.where(~is_blank("canonical_url") & ~is_blank("dedup_key"))
    first = top_per_key(usable, ["source_id", "dedup_key"], [F.col("pos")], 1)
    judged = first.join(registry.select("source_id", "domain", "allowed_hosts"), "source_id").withColumn(
        "host", host("canonical_url")
    ).withColumn("allowed", nulls_to(host_allowed(F.col("host"), F.col("domain"), F.col("allowed_hosts")), False))
    kept = top_per_key(judged.where("allowed"), ["source_id"], [F.col("pos")], per_source).drop("domain", "allowed_hosts", "allowed")
    refused = judged.where("not allowed")
    counts = refused.groupBy("source_id").agg(F.count("*").alias("filtered_count"))
    firsts = refused.where("host is not null").groupBy("source_id", "host").agg(F.min("pos").alias("pos"))
    five = (
        top_per_key(firsts, ["source_id"], [F.col("pos")], 5)
        .groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "host"))).alias("d"))
        .select("source_id", F.transform("d", lambda s: s["host"]).alias("filtered_domains"))
    )
    return kept, counts.join(five, "source_id", "left")


def due_sources(registry: DataFrame, as_of, limit: int) -> DataFrame:
    due = F.col("next_run_at").isNull() | (F.col("next_run_at") <= ts(as_of))
    return registry.where(F.col("enabled") & F.col("allow_auto_crawl") & due).orderBy("id").limit(max(1, limit))


def pending_retries(jobs: DataFrame, as_of, limit: int = 20) -> DataFrame:
    return (
        jobs.where((F.col("status") == "PENDING") & (F.col("trigger_type") == "RETRY") & (F.col("discovered_at") <= ts(as_of)))
        .orderBy("discovered_at", "id").limit(limit)
    )


def mark_stale(jobs: DataFrame, as_of, minutes: int = 90) -> DataFrame:
    """Jobs stuck before their first stage become retryable failures; stale tells which ones."""
    stale = (
        (F.col("status") == "PROCESSING") & F.col("stage").isin("QUEUED", "PREPARING")
        & (F.col("updated_at") < ts(as_of) - F.make_dt_interval(mins=F.lit(minutes)))
    )
    out = jobs.withColumn("stale", nulls_to(stale, False))
    return out.withColumns({
        "last_failed_stage": F.when(F.col("stale"), F.coalesce("stage", F.lit("UNKNOWN"))),
        "document_status": F.when(F.col("stale"), "FAILED"),
        "status": F.when(F.col("stale"), "FAILED_RETRYABLE").otherwise(F.col("status")),
        "stage": F.when(F.col("stale"), "QUEUE_TIMEOUT_STALE").otherwise(F.col("stage")),
    })


def gate_images(images: DataFrame, reject_words=None) -> DataFrame:
    """Usable cover candidates, first of each url per document (by pos)."""
    ratio = F.col("width") / F.col("height")
    fingerprint = F.lower(F.concat_ws(" ", text("url"), text("caption")))
    ok = (
        F.rlike(text("url"), F.lit(r"(?i)^https?://[^/?#@]+(?:[/?#]|$)"))
        & (is_blank("candidate_status") | (F.col("candidate_status") == "VALID"))
        & (F.col("width") >= 600) & (F.col("height") >= 250) & ratio.between(0.75, 2.4)
        & ~has_any(fingerprint, reject_words or V.IMAGE_REJECT_WORDS)
    )
    return top_per_key(images.where(ok), ["document_id", "url"], [F.col("pos")], 1)


def preselect(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.col("imported") & (F.col("relevance_level") != "LOW"))


# --------------------------------------------------------------- commercial --


def active_campaign(campaigns: DataFrame, regions: DataFrame, as_of) -> DataFrame:
    """One running campaign per region: the newest of the region, else the newest without a region."""
    now = ts(as_of)
    running = campaigns.where(
        (F.col("status") == "ACTIVE")
        & (F.col("start_at").isNull() | (F.col("start_at") <= now))
        & (F.col("end_at").isNull() | (F.col("end_at") > now))
    )
    own = running.where("region_code is not null").groupBy("region_code").agg(F.max("id").alias("own_id"))
    anywhere = running.where("region_code is null").agg(F.max("id").alias("any_id"))  # one row
    return (
        regions.select("region_code").join(own, "region_code", "left").crossJoin(anywhere)
        .select("region_code", F.coalesce("own_id", "any_id").alias("campaign_id")).where("campaign_id is not null")
    )


def list_services(products: DataFrame, providers: DataFrame, region: str | None = None) -> DataFrame:
    """Active products of verified providers; free ones first, then well described ones, newest first."""
    verified = providers.where("status = 'ACTIVE' and verification_status = 'VERIFIED'").select(
        F.col("id").alias("provider_id"), F.col("name").alias("provider_name")
    )
    out = products.where("status = 'ACTIVE'")
    if region is not None:
        out = out.where(F.col("region_code") == region.strip())
    return out.join(verified, "provider_id").orderBy(
        (F.col("price_cents") != 0).cast("int"), (F.length("description") <= 50).cast("int"), F.desc("id")
    )


def active_membership(memberships: DataFrame, plans: DataFrame, as_of) -> DataFrame:
    """Latest-expiring active membership of each user with its plan."""
    live = memberships.where(F.col("status").isin("ACTIVE", "DEMO_ACTIVE_MEMBERSHIP") & (F.col("expires_at") > ts(as_of)))
    latest = live.groupBy("resident_user_id").agg(
        F.max(F.struct("expires_at", "id", "status", "starts_at", "plan_id")).alias("m")
    ).select("resident_user_id", "m.*")
    return latest.join(plans.select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name"), "billing_period"), "plan_id")


# ----------------------------------------------------------------- back office --


def backfill_candidates(
    docs: DataFrame, items: DataFrame, jobs: DataFrame | None = None, only_missing: bool = False, source_id=None,
    kind: str | None = None, publish_status: str | None = None, from_date=None, to_date=None, limit: int = 500,
    types=("WEB_ARTICLE", "PDF", "IMAGE"),
) -> DataFrame:
    """Documents whose cover should be rebuilt; every filter is optional."""
    out = docs.where(F.col("source_type").isin(list(types)))
    if only_missing:
        out = out.where(F.col("custom_cover_path").isNull() | (F.col("cover_image_type") == "CATEGORY_DEFAULT"))
    if kind:
        out = out.where(F.col("content_kind") == kind.strip())
    if from_date:
        out = out.where(F.col("imported_at") >= ts(from_date))
    if to_date:
        out = out.where(F.col("imported_at") < F.date_add(F.lit(to_date).cast("date"), 1).cast("timestamp_ntz"))
    if source_id is not None:
        out = out.join(jobs.where(F.col("source_registry_id") == source_id).select(F.col("document_id").alias("id")), "id", "left_semi")
    published = items.select(F.col("document_id").alias("id"), F.col("status").alias("publish_status"))
    if publish_status:
        out = out.join(published.where(F.col("publish_status") == publish_status.strip().upper()), "id")
    else:
        out = out.join(published, "id", "left")
    return out.orderBy("id").limit(limit)


def for_org(df: DataFrame, organization_id=None, order: str = "created_at", limit: int = 200) -> DataFrame:
    """Tenant rows, newest first; an administrator (None) sees all."""
    out = df if organization_id is None else df.where(F.col("organization_id") == organization_id)
    return out.orderBy(F.desc(order), F.desc("id")).limit(limit)


def status_groups(docs: DataFrame, groups=None, query: str = "") -> DataFrame:
    """Count per tab, including ALL; empty tabs count 0."""
    groups = groups or V.STATUS_GROUPS
    rows = docs.where(F.contains(text("title"), F.lit(query))) if query else docs
    one = rows.agg(
        F.count("*").alias("ALL"), *[F.count_if(F.col("status").isin(members)).alias(g) for g, members in groups.items()]
    )
    return one.select(F.expr("stack({}, {}) as (status_group, n)".format(
        len(groups) + 1, ", ".join(f"'{g}', `{g}`" for g in ["ALL", *groups])
    )))


def todo(docs: DataFrame) -> DataFrame:
    """Failed, waiting and reviewed documents with rank, reason and priority."""
    s = F.col("status")
    rank = F.when(s == "FAILED", 1).when(s == "WAITING_REVIEW", 2).when(s == "REVIEWED", 3)
    reason = (
        F.when(s == "FAILED", "处理没有完成，原文件仍已保留。")
        .when((s == "WAITING_REVIEW") & (F.col("source_type") == "WEB_ARTICLE"), "请核对来源、封面和正文依据。")
        .when(s == "WAITING_REVIEW", "AI 结果已生成，请对照原文确认。")
        .when(s == "REVIEWED", "审核已完成，请预览用户端效果后发布。")
    )
    priority = F.when(s == "FAILED", "需要关注").when(s == "WAITING_REVIEW", "待审核").when(s == "REVIEWED", "待发布")
    return docs.withColumns({"todo_rank": rank, "reason": reason, "priority": priority}).where("todo_rank is not null").orderBy("todo_rank", "id")


def search_log(log: DataFrame, query: str = "", day: str = "") -> DataFrame:
    """Text in operator, action or target; day is a prefix of the creation time."""
    joined = F.concat(text("operator_name"), text("action"), text("target_type"), text("target_id"))
    out = log
    if query.strip():
        out = out.where(F.contains(joined, F.lit(query.strip())))
    if day:
        out = out.where(F.startswith(F.col("created_at").cast("string"), F.lit(day)))
    return out


def valid_events(events: DataFrame, items: DataFrame, types=None) -> DataFrame:
    """Events the platform accepts: listed usage types, or a VIEW of a published item; visitor id 1..80 characters."""
    kind = F.upper(F.trim("event_type"))
    ok_visitor = ~is_blank("visitor_id") & (F.length("visitor_id") <= 80)
    usage = events.where(kind.isin(types or V.USAGE_EVENT_TYPES) & ok_visitor)
    published = items.where(F.col("status") == "PUBLISHED").select(F.col("id").alias("item_id"))
    views = events.where(kind == "VIEW").join(published, "item_id", "left_semi")
    return usage.unionByName(views).withColumn("event_type", kind)
