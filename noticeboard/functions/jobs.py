"""Job outcome and source configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V
from .core import col, is_blank, nulls_to, strip
from .urls import host, normalize_url


def job_outcome(added, duplicate, skipped, failed, failures, started=None, finished=None) -> Column:
    """Struct(failed_count, status, duration_ms)."""
    n = F.greatest(col(failed), col(failures))
    status = (
        F.when(n == 0, "SUCCESS").when(col(added) + col(duplicate) + col(skipped) > 0, "PARTIAL_SUCCESS").otherwise("FAILED")
    )
    if started is None:
        duration = F.lit(0).cast("bigint")
    else:
        ms = F.unix_millis(col(finished).cast("timestamp")) - F.unix_millis(col(started).cast("timestamp"))
        duration = nulls_to(F.greatest(F.lit(0).cast("bigint"), ms), 0)
    return F.struct(n.alias("failed_count"), status.alias("status"), duration.alias("duration_ms"))


def validate_source(zones: list[str] | None = None) -> Column:
    """Array of error codes of one source configuration row (empty when valid).

    zones is the list of accepted time-zone names; None skips that check.
    """

    def norm(c, default=None):
        out = F.upper(strip(c))
        return out if default is None else F.when(out == "", F.lit(default)).otherwise(out)

    def bad_url(c):
        return ~is_blank(c) & (normalize_url(c).isNull() | nulls_to(host(c) != domain, True))

    home_host = F.when(normalize_url("homepage_url").isNotNull(), host("homepage_url"))
    domain = F.when(is_blank("domain"), home_host).otherwise(F.lower(strip("domain")))
    crawl_time = F.when(is_blank("daily_crawl_time"), F.lit(V.DEFAULT_CRAWL_TIME)).otherwise(strip("daily_crawl_time"))
    policy = norm("image_usage_policy", "MANUAL_REVIEW")
    auto_or_cache = nulls_to(F.col("auto_approve_images"), False) | nulls_to(F.col("image_cache_allowed"), False)

    def outside(c, default, lo, hi):
        return ~nulls_to(F.col(c), default).between(lo, hi)

    checks = [
        ("NAME_BLANK", is_blank("name")),
        ("TYPE", ~norm("type").isin(V.SOURCE_REGISTRY_TYPES)),
        ("DISCOVERY_MODE", ~norm("discovery_mode").isin(V.DISCOVERY_MODES)),
        ("HOMEPAGE", home_host.isNull()),
        ("DOMAIN", home_host.isNotNull() & (domain != home_host)),
        ("RSS_URL", bad_url("rss_url")), ("SITEMAP_URL", bad_url("sitemap_url")), ("SECTION_URL", bad_url("section_url")),
        ("MAX_ARTICLES", outside("max_articles_per_run", 5, 1, 100)),
        ("BUDGET", outside("daily_article_budget", 0, 0, 10000) | outside("daily_token_budget", 0, 0, 100000000)),
        ("CRAWL_TIME", ~F.rlike(crawl_time, F.lit(r"^(?:[01]\d|2[0-3]):[0-5]\d$"))),
        ("AUTHORITY", ~norm("authority_level", "B").isin("A", "B", "C")),
        ("SCHEDULE_MODE", ~norm("schedule_mode", "DAILY").isin(V.SCHEDULE_MODES)),
        ("INTERVAL_HOURS", outside("interval_hours", 24, 1, 168)),
        ("RECENT_DAYS", ~nulls_to(F.col("recent_days"), 7).isin(V.RECENT_DAYS)),
        ("MAX_RETRIES", outside("max_retries", 3, 0, 10)),
        ("DUPLICATE_STRATEGY", ~norm("duplicate_strategy", "SKIP").isin(V.DUPLICATE_STRATEGIES)),
        ("IMAGE_POLICY", ~policy.isin(V.IMAGE_POLICIES)),
        ("IMAGE_BASIS", auto_or_cache & ((policy == "MANUAL_REVIEW") | is_blank("image_usage_basis"))),
    ]
    if zones is not None:
        zone = F.when(is_blank("schedule_timezone"), F.lit(V.DEFAULT_ZONE)).otherwise(strip("schedule_timezone"))
        checks.append(("TIMEZONE", ~zone.isin(zones)))
    return F.array_except(
        F.array(*[F.when(nulls_to(c, True), F.lit(n)) for n, c in checks]), F.array(F.lit(None).cast("string"))
    )
