"""Aggregations: metrics, roll-ups, merges and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.core import LINE_BREAK, col, is_blank, nulls_to, text
from ..functions.dates import ts
from .filters import visible
from .joins import engagement
from .ordered import running_totals


def rate(n: Column, d: Column) -> Column:
    """Percentage with one decimal; 0 when the denominator is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.floor(n * F.lit(1000.0) / d + F.lit(0.5)) / F.lit(10.0))


def duration_ms(start="started_at", end="finished_at") -> Column:
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / F.lit(1000.0)


def mean_ms(c: Column) -> Column:
    """Mean rounded to a whole number; 0 without rows."""
    return nulls_to(F.floor(F.avg(c) + F.lit(0.5)), 0).cast("bigint")


def avg_ms(jobs: DataFrame) -> DataFrame:
    return jobs.agg(mean_ms(duration_ms()).alias("avg_ms"))


def queue_status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(
        F.count("*").alias("item_count"),
        nulls_to(F.sum("estimated_tokens"), 0).alias("estimated_tokens"),
        nulls_to(F.sum("actual_tokens"), 0).alias("actual_tokens"),
    ).orderBy("status")


def weekly(items, engagements, usage, favorites, reminders, as_of, days: int = 7) -> DataFrame:
    """Counts of the trailing days, one scan per table."""
    cut = ts(as_of) - F.make_dt_interval(days=F.lit(days))
    return (
        items.agg(F.count_if((F.col("status") == "PUBLISHED") & (F.col("published_at") >= cut)).alias("weekly_published"))
        .crossJoin(engagements.agg(F.count_if((F.col("event_type") == "VIEW") & (F.col("created_at") >= cut)).alias("weekly_views")))
        .crossJoin(usage.agg(F.count_if((F.col("event_type") == "CONTENT_LISTEN") & (F.col("created_at") >= cut)).alias("weekly_listens")))
        .crossJoin(favorites.agg(F.count_if(F.col("created_at") >= cut).alias("weekly_favorites")))
        .crossJoin(reminders.agg(F.count_if(F.col("created_at") >= cut).alias("weekly_reminders")))
    )


def today(jobs: DataFrame, as_of) -> DataFrame:
    """Sums of crawl counters since midnight."""
    start = F.date_trunc("day", ts(as_of))
    since = F.col("discovered_at") >= start.cast("timestamp_ntz")
    return jobs.agg(*[
        nulls_to(F.sum(F.when(since, F.col(f"{c}_count"))), 0).cast("bigint").alias(f"today_{c}")
        for c in ("discovered", "added", "duplicate", "failed")
    ])


def ops_metrics(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Operations figures as one row.

    t maps table names (registry, crawl_jobs, documents, items, jobs, audits,
    engagements, usage, favorites, reminders, assistant, reviews, images, budget) to
    frames; every table is scanned once and the one-row aggregates are put side by side.
    A request counts when it was executed; both success spellings count.
    """
    day = ts(as_of).cast("date")
    succeeded = F.count_if(F.col("result").isin("SUCCESS", "SUCCEEDED"))
    requests = F.count("*")
    frames = [
        t["registry"].agg(
            F.count("*").alias("source_count"),
            nulls_to(F.sum(F.when(F.col("enabled"), F.col("daily_token_budget"))), 0).cast("bigint").alias("token_budget_total"),
        ),
        t["crawl_jobs"].agg(
            nulls_to(F.sum("discovered_count"), 0).alias("discovered"),
            F.count_if(F.col("status").isin("SUCCESS", "SUCCEEDED")).alias("successful_crawls"),
            nulls_to(F.sum("duplicate_count"), 0).alias("duplicates"),
            mean_ms(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))).alias("average_crawl_ms"),
        ),
        t["documents"].agg(
            F.count_if(F.col("processing_status") == "WAITING_REVIEW").alias("waiting_review"),
            F.count_if(F.col("processing_status") == "FAILED").alias("failed"),
        ),
        t["items"].agg(F.count_if(F.col("status") == "PUBLISHED").alias("published")),
        t["jobs"].agg(mean_ms(duration_ms()).alias("average_processing_ms")),
        t["audits"].where("executed").agg(
            requests.alias("ai_requests"), nulls_to(F.sum("actual_tokens"), 0).alias("ai_tokens"),
            rate(succeeded, requests).alias("ai_success_rate"),
        ),
        t["engagements"].agg(F.count_if(F.col("event_type") == "VIEW").alias("views")),
        t["favorites"].agg(F.count("*").alias("favorites")),
        t["images"].agg(F.count_if(F.col("review_status") == "PENDING").alias("pending_images")),
        t["budget"].agg(nulls_to(F.sum(F.when(F.col("budget_date") == day, F.col("actual_tokens"))), 0).alias("tokens_used_today")),
        assistant_usage(t["assistant"]).select("assistant_queries", "cited_answer_rate"),
        edit_rate(t["reviews"]),
        today(t["crawl_jobs"], as_of),
        weekly(t["items"], t["engagements"], t["usage"], t["favorites"], t["reminders"], as_of),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)  # one row each
    return out


def service_directory(items: DataFrame, fields: DataFrame, region_code: str, as_of) -> DataFrame:
    """Address, phone and hours of each visible item of a region; items without fields stay."""
    kept = visible(items, as_of).where((F.col("region_code") == region_code.strip()) & (text("source_url") != ""))
    pivot = fields.where("review_status <> 'REJECTED'").groupBy("document_id").agg(
        F.max(F.when(F.col("field_type") == "LOCATION", F.col("field_value"))).alias("address"),
        F.max(F.when(F.col("field_type") == "CONTACT", F.col("field_value"))).alias("phone"),
        F.max(F.when(F.col("field_type").isin("SERVICE_TIME", "TIME"), F.col("field_value"))).alias("opening_hours"),
    )
    return kept.join(pivot, "document_id", "left").select(
        "id", F.col("title").alias("name"), F.col("category").alias("service_type"), "address", "phone", "opening_hours",
        F.col("summary").alias("description"), "source_url", "source_name", "last_verified_at",
    ).orderBy(F.desc("last_verified_at"), F.desc("id"))


def suggestions(items: DataFrame, table=None, default: str = V.DEFAULT_SUGGESTION, limit: int = 4) -> DataFrame:
    """Suggested questions for the published categories."""
    table = table or V.SUGGESTIONS
    have = items.where("status = 'PUBLISHED'").agg(*[F.max(F.col("category") == c).alias(f"c{i}") for i, (c, _) in enumerate(table)])
    picks = F.array(*[F.when(F.col(f"c{i}"), F.lit(s)) for i, (_, s) in enumerate(table)])
    found = F.filter(picks, lambda x: x.isNotNull())
    chosen = F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(F.slice(found, 1, limit))
    return have.select(F.posexplode(chosen).alias("pos", "suggestion"))


def coverage(items: DataFrame, targets=None, recommend_target: int = V.RECOMMEND_TARGET, channel: str = "publish_channel") -> DataFrame:
    """Count and pass flag per target channel, plus RECOMMEND."""
    targets = targets or V.COVERAGE_TARGETS
    one = items.agg(
        *[F.count_if(F.col(channel) == c).alias(c) for c in targets],
        F.count_if(nulls_to(F.col("promote_to_recommend"), False)).alias("RECOMMEND"),
    )
    goals = {**targets, "RECOMMEND": recommend_target}
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("n"), F.lit(g).alias("target")) for c, g in goals.items()])
    return one.select(F.inline(rows)).withColumn("passed", F.col("n") >= F.col("target"))


def status_profile(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Labelled counts by channel and status, with totals."""
    published = items.where("status = 'PUBLISHED'")
    by_channel = published.groupBy(F.col("publish_channel").alias("label")).agg(F.count("*").alias("n"))
    by_status = docs.groupBy(F.col("processing_status").alias("label")).agg(F.count("*").alias("n"))
    totals = docs.agg(
        F.count_if((F.col("processing_status") == "WAITING_REVIEW") & (F.col("source_type") == "WEB_ARTICLE")).alias("w"),
        F.count_if(F.col("source_type") == "WEB_ARTICLE").alias("a"),
    ).select(F.expr("stack(2, 'waiting_review_web', w, 'web_article_total', a) as (metric, n)"))
    none = F.lit(None).cast("string").alias("label")
    return (
        by_channel.select(F.lit("published_by_channel").alias("metric"), "label", "n")
        .unionByName(by_status.select(F.lit("source_doc_by_status").alias("metric"), "label", "n"))
        .unionByName(totals.select("metric", none, "n"))
        .unionByName(published.agg(F.count("*").alias("n")).select(F.lit("published_total").alias("metric"), none, "n"))
    )


def commercial_overview(t: dict[str, DataFrame], as_of) -> DataFrame:
    """Commercial counters as one row; this month means the calendar month of as_of."""
    month = F.date_trunc("month", ts(as_of))

    def this_month(c):
        return F.date_trunc("month", F.col(c)) == month

    frames = [
        t["plans"].agg(F.count("*").alias("plans")),
        t["subscriptions"].agg(F.count_if(F.col("status") == "ACTIVE").alias("active_subscriptions")),
        t["members"].agg(
            F.count_if((F.col("status") == "DEMO_ACTIVE_MEMBERSHIP") & (F.col("expires_at") > ts(as_of))).alias("active_members"),
            F.count_if(this_month("created_at")).alias("new_members_this_month"),
        ),
        t["providers"].agg(F.count_if((F.col("verification_status") == "VERIFIED") & (F.col("status") == "ACTIVE")).alias("verified_providers")),
        t["products"].agg(F.count_if(F.col("status") == "ACTIVE").alias("active_products")),
        t["orders"].agg(F.count_if(this_month("created_at")).alias("orders_this_month")),
        t["refunds"].agg(F.count_if(F.col("status") == "REQUESTED").alias("pending_refunds")),
        t["sponsors"].agg(F.count_if(F.col("status") == "ACTIVE").alias("active_sponsors")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def budget_usage(reservations: DataFrame) -> DataFrame:
    """Ledger of reservations per day for GLOBAL and per SOURCE; exempt rows do not count."""
    charged = reservations.where(~F.col("budget_exempt"))
    scopes = F.array(
        F.struct(F.lit("GLOBAL").alias("scope_type"), F.lit(0).cast("bigint").alias("scope_id")),
        F.struct(F.lit("SOURCE").alias("scope_type"), F.col("source_id").cast("bigint").alias("scope_id")),
    )
    open_ = F.col("status") == "RESERVED"
    # per (day, source) first, so GLOBAL rows are a sum of few partial rows
    partial = charged.groupBy("budget_date", "source_id").agg(
        F.count_if(open_).alias("reserved_articles"),
        F.count_if(F.col("status") == "SETTLED").alias("settled_articles"),
        nulls_to(F.sum(F.when(open_, F.col("estimated_tokens"))), 0).alias("reserved_tokens"),
        nulls_to(F.sum("actual_tokens"), 0).alias("actual_tokens"),
    )
    return (
        partial.select("*", F.explode(scopes).alias("s")).where("s.scope_id is not null")
        .groupBy("budget_date", F.col("s.scope_type").alias("scope_type"), F.col("s.scope_id").alias("scope_id"))
        .agg(*[F.sum(c).alias(c) for c in ("reserved_articles", "settled_articles", "reserved_tokens", "actual_tokens")])
    )


# ------------------------------------------------------------------- merging --


def merge_facts(chunks: DataFrame, doc: str = "doc_id", key: str = "list_key", value: str = "item", order=("chunk_no", "pos")) -> DataFrame:
    """Union of the chunks' items per list, distinct by canonical JSON, at their first position.

    The value is a struct or a JSON object string; keys are compared in sorted order.
    One row per surviving item (a list can be of any size).
    """
    if dict(chunks.dtypes)[value].startswith("struct"):
        fields = sorted(chunks.schema[value].dataType.fieldNames())
        canonical = F.to_json(F.struct(*[F.col(f"{value}.{f}").alias(f) for f in fields]), {"ignoreNullFields": "false"})
    else:
        pairs = F.array_sort(F.map_entries(F.from_json(F.col(value), "map<string,string>")))
        canonical = F.to_json(F.map_from_entries(pairs))
    return (
        chunks.withColumn("canonical", canonical).groupBy(doc, key, "canonical")
        .agg(F.min(F.struct(*order)).alias("first_pos")).select(doc, key, "canonical", "first_pos.*")
    )


def merge_windows(windows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Service windows with the same days, dates and times become one."""
    keyed = windows.withColumns({
        "k_days": F.array_sort("days"), "k_dates": F.array_sort("dates"), "k_times": F.col("time_ranges"),
    })
    note_len = F.struct(F.length("unavailable_note"), -F.col("pos"))
    return keyed.groupBy(doc, "k_days", "k_dates", "k_times").agg(
        F.min("pos").alias("pos"),
        F.min_by(F.nullif("location", F.lit("")), F.when(~is_blank("location"), F.col("pos"))).alias("location"),
        F.max_by("unavailable_note", F.when(~is_blank("unavailable_note"), note_len)).alias("unavailable_note"),
        F.max_by("source_quote", F.struct(F.length("source_quote"), -F.col("pos"))).alias("source_quote"),
        F.bool_or("needs_human_review").alias("needs_human_review"),
    )


def merge_fees(fees: DataFrame, doc: str = "doc_id", suffix: str = V.FEE_NAME_SUFFIX, unit: str = "元", per=("每", "/")) -> DataFrame:
    """Fees of the same kind become one: most telling amount, longest rule and quote, shortest name, all methods."""
    key = F.regexp_replace(F.regexp_replace(text("fee_type"), r"(?U)\s+", ""), suffix, "")
    has_per = F.lit(False)
    for p in per:
        has_per = has_per | F.contains(F.col("amount"), F.lit(p))
    telling = F.struct(F.contains(F.col("amount"), F.lit(unit)), has_per, F.length("amount"), -F.col("pos"))
    merged = fees.withColumn("fee_key", key).groupBy(doc, "fee_key").agg(
        F.min("pos").alias("pos"),
        F.min_by("fee_type", F.struct(F.length("fee_type"), F.col("pos"))).alias("fee_type"),
        F.max_by("amount", F.when(~is_blank("amount"), telling)).alias("amount"),
        F.max_by("rule", F.when(~is_blank("rule"), F.struct(F.length("rule"), -F.col("pos")))).alias("rule"),
        F.max_by("source_quote", F.struct(F.length("source_quote"), -F.col("pos"))).alias("source_quote"),
        F.bool_or("needs_human_review").alias("needs_human_review"),
    )
    # methods: distinct first, so the list is bounded by the number of methods
    methods = (
        fees.withColumn("fee_key", key).select(doc, "fee_key", "pos", F.posexplode("payment_methods").alias("mpos", "method"))
        .groupBy(doc, "fee_key", "method").agg(F.min(F.struct("pos", "mpos")).alias("p"))
        .groupBy(doc, "fee_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "method"))), lambda s: s["method"]).alias("payment_methods"))
    )
    return merged.join(methods, [doc, "fee_key"], "left").withColumn(
        "payment_methods", F.coalesce("payment_methods", F.array().cast("array<string>"))
    )


def rollup(chunks: DataFrame, mode: str = "parallel", doc: str = "doc_id") -> DataFrame:
    """Usage of a document's chunks; elapsed time is the longest (parallel) or the sum (sequential) of them.

    The digest covers the chunk digests in order; chunks per document are few by
    construction (chunk packing folds the tail).
    """
    elapsed = F.max("elapsed_ms") if mode == "parallel" else F.sum("elapsed_ms")
    return chunks.groupBy(doc).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        elapsed.alias("elapsed_ms"), F.sum("retry_count").alias("retry_count"), F.sum("response_length").alias("response_length"),
        F.bool_and("parse_ok").alias("json_parse_success"), F.bool_or("normalized").alias("normalization_applied"),
        F.sha2(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("chunk_no", "response_sha256"))), lambda s: s["response_sha256"]
        ), ""), 256).alias("response_sha256"),
    )


# ----------------------------------------------------------------- statistics --


def latency(samples: DataFrame, key: str, value: str, percents=(50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles: the value at index ceil(p*n)-1 of the sorted samples.

    Values are counted first and ranked by a running total over the distinct
    values, so neither a hot group nor the whole sample meets in one task.
    """
    counted = samples.groupBy(key, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counted, [key], [F.col(value)], before=F.col("n"))
    totals = counted.groupBy(key).agg(F.sum("n").alias("total"), F.max(value).alias("max"))
    placed = ranked.join(totals, key)
    cols = []
    for p in percents:
        # integer arithmetic: ceil(p * n / 100) without floating point
        rank = F.greatest(F.lit(1), F.floor((F.col("total") * p + 99) / 100)).cast("bigint")
        here = (F.col("before") < rank) & (rank <= F.col("before") + F.col("n"))
        cols.append(F.max(F.when(here, F.col(value))).alias(f"p{p}"))
    return placed.groupBy(key).agg(F.max("total").alias("samples"), *cols, F.max("max").alias("max"))


def assistant_usage(events: DataFrame, *keys: str) -> DataFrame:
    n, cited = F.count("*"), F.count_if(F.col("citation_count") > 0)
    return events.groupBy(*keys).agg(n.alias("assistant_queries"), cited.alias("cited_answers"), rate(cited, n).alias("cited_answer_rate"))


def edit_rate(reviews: DataFrame) -> DataFrame:
    changed = F.count_if(text("before_snapshot") != text("after_snapshot"))
    return reviews.agg(rate(changed, F.count("*")).alias("manual_edit_rate"))


def eta(jobs: DataFrame, as_of, hours: int = 72) -> DataFrame:
    """Queue position and estimated remaining time of every job."""
    open_status = ["PROCESSING", "WAITING_BUDGET", "WAITING_APPROVAL"]
    recent = jobs.where(
        F.col("status").isin("SUCCEEDED", *open_status) & (F.col("job_type") == "FULL_PIPELINE")
        & (F.col("started_at") > ts(as_of) - F.make_dt_interval(hours=F.lit(hours)))
    )
    mean = recent.agg(F.avg(duration_ms()).alias("avg_ms"))  # one row
    placed = queue_position(jobs).crossJoin(mean)
    rest = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("avg_ms") * (F.lit(1.0) - F.col("progress") / F.lit(100.0)) + F.lit(0.5)))
    queued = F.when(F.col("queue_position") > 0, F.floor(F.col("avg_ms") + F.lit(0.5)) * F.col("queue_position")).otherwise(0)
    return placed.withColumn("estimated_ms", F.when(F.col("avg_ms") > 0, rest + queued)).drop("avg_ms")


def queue_position(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs with a smaller id."""
    unfinished = F.col("status").isin("PROCESSING", "WAITING_BUDGET", "WAITING_APPROVAL").cast("bigint")
    return running_totals(jobs, [], [F.col("id")], queue_position=unfinished)


def post_counters(posts: DataFrame, likes: DataFrame, comments: DataFrame, reports: DataFrame) -> DataFrame:
    """Likes and visible comments per post, open reports of reported or hidden posts."""
    facts = (
        likes.select("post_id", F.lit("L").alias("t"))
        .unionByName(comments.where("status = 'VISIBLE'").select("post_id", F.lit("C").alias("t")))
        .unionByName(reports.where("status = 'OPEN'").select("post_id", F.lit("R").alias("t")))
    )
    counts = facts.groupBy("post_id").agg(
        F.count_if(F.col("t") == "L").alias("like_count"), F.count_if(F.col("t") == "C").alias("comment_count"),
        F.count_if(F.col("t") == "R").alias("open_reports"),
    )
    out = posts.join(counts, posts["id"] == counts["post_id"], "left").drop("post_id")
    return out.withColumns({
        "like_count": nulls_to(F.col("like_count"), 0), "comment_count": nulls_to(F.col("comment_count"), 0),
        "report_count": F.when(F.col("status").isin("REPORTED", "HIDDEN"), nulls_to(F.col("open_reports"), 0)),
    }).drop("open_reports")


def crawl_rollup(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source_registry_id").agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status").isin("SUCCESS", "SUCCEEDED")).alias("successes"),
        nulls_to(F.sum("discovered_count"), 0).alias("discovered"), nulls_to(F.sum("added_count"), 0).alias("added"),
    )


def popular(items: DataFrame, events: DataFrame, favorites: DataFrame, usage: DataFrame, n: int = 5) -> DataFrame:
    """Published items by views, favourites, listens, then newest (id last)."""
    facts = (
        events.where("event_type = 'VIEW'").select("item_id", F.lit("VIEW").alias("event_type"))
        .unionByName(favorites.select("item_id", F.lit("FAVORITE").alias("event_type")))
        .unionByName(usage.where("event_type = 'CONTENT_LISTEN'").select("item_id", F.lit("LISTEN").alias("event_type")))
    )
    counts = engagement(facts, views="VIEW", favorites="FAVORITE", listens="LISTEN")
    out = items.where("status = 'PUBLISHED'").join(counts, F.col("id") == F.col("item_id"), "left").drop("item_id")
    out = out.withColumns({c: nulls_to(F.col(c), 0) for c in ("views", "favorites", "listens")})
    return out.orderBy(F.desc("views"), F.desc("favorites"), F.desc("listens"), F.desc("published_at"), F.desc("id")).limit(n)


# -------------------------------------------------------------------- text ----


def strip_repeated_edges(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", body: str = "text") -> DataFrame:
    """Remove header and footer lines repeated over the pages of a document (three or more pages)."""
    lines = F.filter(F.split(F.col(body), LINE_BREAK), lambda x: x != "")
    split = pages.withColumn("_lines", lines)
    edges = split.select(
        doc, F.explode(F.filter(F.array(F.try_element_at("_lines", F.lit(1)), F.try_element_at("_lines", F.lit(-1))), lambda x: x.isNotNull())).alias("line")
    ).where(F.length("line").between(2, 99)).groupBy(doc, "line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy(doc).agg(F.count("*").alias("_pages"))
    # a repeated line is on 60 % of the pages, so there are at most four per document
    repeated = (
        edges.join(sizes, doc).where((F.col("_pages") >= 3) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * 3 / F.lit(5)))))
        .groupBy(doc).agg(F.collect_list("line").alias("_rep"))
    )
    out = split.join(repeated, doc, "left")
    cleaned = F.trim(F.array_join(F.filter("_lines", lambda x: ~F.array_contains("_rep", x)), "\n"))
    return out.withColumn(body, F.when(F.col("_rep").isNull(), F.col(body)).otherwise(cleaned)).drop("_lines", "_rep")


def fact_audit(facts: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Counts per reason plus raw, schema_valid and trace_valid totals."""
    counted = facts.groupBy(F.coalesce(reason, F.lit("trace_valid")).alias("reason")).agg(F.count("*").alias("n"))
    totals = counted.agg(
        F.sum("n").alias("raw"), nulls_to(F.sum(F.when(F.col("reason") != "schema_invalid", F.col("n"))), 0).alias("ok"),
    ).select(F.expr("stack(2, 'raw', coalesce(raw, 0L), 'schema_valid', ok) as (reason, n)"))
    return counted.unionByName(totals)


def latest(df: DataFrame, n: int, *order: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Newest n rows (n clamped to lo..hi when given)."""
    if lo is not None:
        n = max(lo, n)
    if hi is not None:
        n = min(hi, n)
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def source_status(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("enabled"), F.desc("last_crawled_at"), "source_name")
