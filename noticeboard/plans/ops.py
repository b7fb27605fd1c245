"""Operations: metrics, queues, crawl jobs, documents, commercial counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A, filters as P, joins as J, ranking as W
from ..sources.tables import load
from .items import MEMBERS_SQL, memberships
from .registry import CRAWL_JOBS, DOCS, EVENTS, ITEMS, JOBS, PARTS, REGISTRY, query

NOW = "1998-06-01 12:00:00"
EV_NOW = "2024-01-20 10:00:00"
_RATE = "CASE WHEN {d}=0 THEN 0.0 ELSE floor({n}*1000.0/{d}+0.5)/10.0 END"


def finished(jobs):
    return jobs.withColumn("finished_at", F.col("started_at") + F.make_dt_interval(secs=F.col("elapsed_ms") / F.lit(1000.0)))


# finished_at is started_at plus whole milliseconds in both engines
FIN = "to_milliseconds(elapsed_ms)"

OPS_SQL = f"""jobs AS {CRAWL_JOBS.sql}, reg AS {REGISTRY.sql}, pj AS {JOBS.sql}, ev AS {EVENTS.sql}, items AS {ITEMS.sql}, docs AS {DOCS.sql}"""


def _tables(spark, d):
    ev, pj = EVENTS(spark, d), JOBS(spark, d)
    turns = load(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("citation_count"))
    return {
        "registry": REGISTRY(spark, d), "crawl_jobs": CRAWL_JOBS(spark, d), "documents": DOCS(spark, d), "items": ITEMS(spark, d),
        "jobs": finished(pj),
        "audits": pj.select(F.col("status").alias("result"), "actual_tokens", (F.col("stage") == "QUEUED").alias("executed")),
        "engagements": ev, "usage": ev, "favorites": ev.where("event_type = 'FAVORITE'"), "reminders": ev.where("event_type = 'REMINDER'"),
        "assistant": turns,
        "reviews": load(spark, d, "lineitem").select(F.col("l_returnflag").alias("before_snapshot"), F.col("l_linestatus").alias("after_snapshot")),
        "images": load(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("APPROVED").alias("review_status")),
        "budget": pj.select(F.col("started_at").cast("date").alias("budget_date"), "actual_tokens"),
    }


@query("operations_metrics", f"""WITH {OPS_SQL},
conv AS (SELECT conv_id, count(*) FILTER (role='assistant') AS c FROM conversations GROUP BY 1)
SELECT (SELECT count(*) FROM reg) AS source_count,
 (SELECT cast(coalesce(sum(daily_token_budget),0) AS bigint) FROM reg WHERE enabled) AS token_budget_total,
 (SELECT cast(sum(discovered_count) AS bigint) FROM jobs) AS discovered,
 (SELECT count(*) FROM jobs WHERE status IN ('SUCCESS','SUCCEEDED')) AS successful_crawls,
 (SELECT cast(sum(duplicate_count) AS bigint) FROM jobs) AS duplicates,
 (SELECT cast(floor(avg(duration_ms)+0.5) AS bigint) FROM jobs WHERE duration_ms>0) AS average_crawl_ms,
 (SELECT count(*) FROM docs WHERE processing_status='WAITING_REVIEW') AS waiting_review,
 (SELECT count(*) FROM docs WHERE processing_status='FAILED') AS failed,
 (SELECT count(*) FROM items WHERE status='PUBLISHED') AS published,
 (SELECT cast(floor(avg(elapsed_ms)+0.5) AS bigint) FROM pj) AS average_processing_ms,
 (SELECT count(*) FROM pj WHERE stage='QUEUED') AS ai_requests,
 (SELECT cast(sum(actual_tokens) AS bigint) FROM pj WHERE stage='QUEUED') AS ai_tokens,
 (SELECT floor(count(*) FILTER (status='SUCCEEDED')*1000.0/count(*)+0.5)/10.0 FROM pj WHERE stage='QUEUED')::double AS ai_success_rate,
 (SELECT count(*) FROM ev WHERE event_type='VIEW') AS views,
 (SELECT count(*) FROM ev WHERE event_type='FAVORITE') AS favorites,
 (SELECT count(*) FROM orders WHERE o_orderstatus='O') AS pending_images,
 (SELECT cast(coalesce(sum(actual_tokens),0) AS bigint) FROM pj WHERE cast(started_at AS date)=date '1998-06-01') AS tokens_used_today,
 (SELECT count(*) FROM conv) AS assistant_queries,
 (SELECT floor(count(*) FILTER (c>0)*1000.0/count(*)+0.5)/10.0 FROM conv)::double AS cited_answer_rate,
 (SELECT floor(count(*) FILTER (l_returnflag<>l_linestatus)*1000.0/count(*)+0.5)/10.0 FROM lineitem)::double AS manual_edit_rate,
 (SELECT cast(coalesce(sum(discovered_count),0) AS bigint) FROM jobs WHERE discovered_at>=timestamp '1998-06-01') AS today_discovered,
 (SELECT cast(coalesce(sum(added_count),0) AS bigint) FROM jobs WHERE discovered_at>=timestamp '1998-06-01') AS today_added,
 (SELECT cast(coalesce(sum(duplicate_count),0) AS bigint) FROM jobs WHERE discovered_at>=timestamp '1998-06-01') AS today_duplicate,
 (SELECT cast(coalesce(sum(failed_count),0) AS bigint) FROM jobs WHERE discovered_at>=timestamp '1998-06-01') AS today_failed,
 (SELECT count(*) FROM items WHERE status='PUBLISHED' AND published_at>=timestamp '1998-05-25 12:00:00') AS weekly_published,
 (SELECT count(*) FROM ev WHERE event_type='VIEW' AND ts>=timestamp '1998-05-25 12:00:00') AS weekly_views,
 (SELECT count(*) FROM ev WHERE event_type='CONTENT_LISTEN' AND ts>=timestamp '1998-05-25 12:00:00') AS weekly_listens,
 (SELECT count(*) FROM ev WHERE event_type='FAVORITE' AND ts>=timestamp '1998-05-25 12:00:00') AS weekly_favorites,
 (SELECT count(*) FROM ev WHERE event_type='REMINDER' AND ts>=timestamp '1998-05-25 12:00:00') AS weekly_reminders""")
def operations_metrics(spark, d):
    return A.ops_metrics(_tables(spark, d), NOW)


@query("weekly_counts", f"""WITH ev AS {EVENTS.sql}, items AS {PARTS.sql}, c AS (SELECT timestamp '2024-01-13 10:00:00' AS t)
SELECT (SELECT count(*) FROM items,c WHERE status='PUBLISHED' AND published_at>=t) AS weekly_published, (SELECT count(*) FROM ev,c WHERE event_type='VIEW' AND ts>=t) AS weekly_views,
(SELECT count(*) FROM ev,c WHERE event_type='CONTENT_LISTEN' AND ts>=t) AS weekly_listens, (SELECT count(*) FROM ev,c WHERE event_type='FAVORITE' AND ts>=t) AS weekly_favorites,
(SELECT count(*) FROM ev,c WHERE event_type='REMINDER' AND ts>=t) AS weekly_reminders""")
def weekly_counts(spark, d):
    ev = EVENTS(spark, d)
    return A.weekly(PARTS(spark, d), ev, ev, ev.where("event_type = 'FAVORITE'"), ev.where("event_type = 'REMINDER'"), EV_NOW)


@query("today_counts", f"""WITH jobs AS {CRAWL_JOBS.sql} SELECT cast(coalesce(sum(discovered_count),0) AS bigint) AS today_discovered, cast(coalesce(sum(added_count),0) AS bigint) AS today_added,
cast(coalesce(sum(duplicate_count),0) AS bigint) AS today_duplicate, cast(coalesce(sum(failed_count),0) AS bigint) AS today_failed FROM jobs WHERE discovered_at>=timestamp '1998-06-01'""")
def today_counts(spark, d):
    return A.today(CRAWL_JOBS(spark, d), NOW)


@query("success_rate_by_source", f"WITH pj AS {JOBS.sql} SELECT source_id, {_RATE.format(n='count(*) FILTER (status=' + chr(39) + 'SUCCEEDED' + chr(39) + ')', d='count(*)')}::double AS success_rate FROM pj GROUP BY 1")
def success_rate_by_source(spark, d):
    return JOBS(spark, d).groupBy("source_id").agg(A.rate(F.count_if(F.col("status") == "SUCCEEDED"), F.count("*")).alias("success_rate"))


@query("mean_processing_time", f"WITH pj AS {JOBS.sql} SELECT cast(floor(avg(elapsed_ms)+0.5) AS bigint) AS avg_ms FROM pj")
def mean_processing_time(spark, d):
    return A.avg_ms(finished(JOBS(spark, d)))


@query("queue_by_status", f"WITH pj AS {JOBS.sql} SELECT status, count(*) AS item_count, cast(sum(estimated_tokens) AS bigint) AS estimated_tokens, cast(sum(actual_tokens) AS bigint) AS actual_tokens FROM pj GROUP BY 1")
def queue_by_status(spark, d):
    return A.queue_status(JOBS(spark, d))


_FIELDS_SQL = """f AS (SELECT l_orderkey AS document_id, CASE WHEN l_linenumber=1 THEN 'LOCATION' WHEN l_linenumber=2 THEN 'CONTACT' WHEN l_linenumber=3 THEN 'SERVICE_TIME' WHEN l_linenumber=4 THEN 'TIME' ELSE 'FEE' END AS field_type,
 concat('v', cast(l_partkey AS string)) AS field_value, CASE l_returnflag WHEN 'R' THEN 'REJECTED' WHEN 'A' THEN 'CONFIRMED' ELSE 'PENDING' END AS review_status FROM lineitem)"""


def line_fields(spark, d):
    n = F.col("l_linenumber")
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.when(n == 1, "LOCATION").when(n == 2, "CONTACT").when(n == 3, "SERVICE_TIME").when(n == 4, "TIME").otherwise("FEE").alias("field_type"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("field_value"),
        F.when(F.col("l_returnflag") == "R", "REJECTED").when(F.col("l_returnflag") == "A", "CONFIRMED").otherwise("PENDING").alias("review_status"),
    )


@query("service_directory", f"""WITH items AS {ITEMS.sql}, {_FIELDS_SQL},
p AS (SELECT document_id, max(field_value) FILTER (field_type='LOCATION') AS address, max(field_value) FILTER (field_type='CONTACT') AS phone, max(field_value) FILTER (field_type IN ('SERVICE_TIME','TIME')) AS opening_hours
 FROM f WHERE review_status<>'REJECTED' GROUP BY 1)
SELECT id, title AS name, category AS service_type, address, phone, opening_hours, source_name FROM items i LEFT JOIN p ON p.document_id=i.document_id
WHERE status='PUBLISHED' AND (expires_at IS NULL OR expires_at>=timestamp '{NOW}') AND publish_channel='FRAUD' AND coalesce(source_url,'')<>''""")
def service_directory(spark, d):
    items = ITEMS(spark, d).withColumn("region_code", F.col("publish_channel"))
    return A.service_directory(items, line_fields(spark, d), "FRAUD", NOW).select("id", "name", "service_type", "address", "phone", "opening_hours", "source_name")


@query("directory_contacts", f"""WITH items AS {ITEMS.sql}, {_FIELDS_SQL}, p AS (SELECT document_id, max(field_value) FILTER (field_type='CONTACT') AS phone FROM f WHERE review_status<>'REJECTED' GROUP BY 1)
SELECT id, phone FROM items i JOIN p ON p.document_id=i.document_id WHERE phone IS NOT NULL AND status='PUBLISHED' AND (expires_at IS NULL OR expires_at>=timestamp '{NOW}') AND publish_channel='FRAUD' AND coalesce(source_url,'')<>''""")
def directory_contacts(spark, d):
    items = ITEMS(spark, d).withColumn("region_code", F.col("publish_channel"))
    return P.directory_by_kind(A.service_directory(items, line_fields(spark, d), "FRAUD", NOW), "contacts").select("id", "phone")


@query("question_suggestions", f"""WITH items AS {PARTS.sql}, have AS (SELECT DISTINCT category FROM items WHERE status='PUBLISHED'),
s AS (SELECT * FROM (VALUES (1,'Brand#3','ask three'),(2,'Brand#99','ask none'),(3,'Brand#7','ask seven')) AS v(o,c,suggestion))
SELECT cast(row_number() OVER (ORDER BY o) - 1 AS int) AS pos, suggestion FROM s WHERE c IN (SELECT category FROM have)""")
def question_suggestions(spark, d):
    table = [("Brand#3", "ask three"), ("Brand#99", "ask none"), ("Brand#7", "ask seven")]
    return A.suggestions(PARTS(spark, d), table, "ask anything")


@query("channel_coverage", f"""WITH items AS {ITEMS.sql}, t AS (SELECT * FROM (VALUES ('HEALTH',5),('MEALS',4000),('SERVICES',5),('RECOMMEND',20)) AS v(channel,target))
SELECT channel, n, target, n>=target AS passed FROM (SELECT channel, target, CASE WHEN channel='RECOMMEND' THEN (SELECT count(*) FROM items WHERE promote_to_recommend) ELSE (SELECT count(*) FROM items WHERE publish_channel=channel) END AS n FROM t)""")
def channel_coverage(spark, d):
    return A.coverage(ITEMS(spark, d), {"HEALTH": 5, "MEALS": 4000, "SERVICES": 5})


@query("status_profile", f"""WITH items AS {ITEMS.sql}, docs AS {DOCS.sql}
SELECT 'published_by_channel' AS metric, publish_channel AS label, count(*) AS n FROM items WHERE status='PUBLISHED' GROUP BY 2
UNION ALL SELECT 'source_doc_by_status', processing_status, count(*) FROM docs GROUP BY 2
UNION ALL SELECT 'waiting_review_web', NULL, count(*) FILTER (processing_status='WAITING_REVIEW' AND source_type='WEB_ARTICLE') FROM docs
UNION ALL SELECT 'web_article_total', NULL, count(*) FILTER (source_type='WEB_ARTICLE') FROM docs
UNION ALL SELECT 'published_total', NULL, count(*) FROM items WHERE status='PUBLISHED'""")
def status_profile(spark, d):
    return A.status_profile(DOCS(spark, d), ITEMS(spark, d))


@query("commercial_overview", f"""WITH {MEMBERS_SQL} SELECT (SELECT count(*) FROM part) AS plans, (SELECT count(*) FROM m WHERE status='ACTIVE') AS active_subscriptions,
(SELECT count(*) FROM m WHERE status='DEMO_ACTIVE_MEMBERSHIP' AND expires_at>timestamp '{NOW}') AS active_members,
(SELECT count(*) FROM m WHERE date_trunc('month', starts_at)=timestamp '1998-06-01') AS new_members_this_month,
(SELECT count(*) FROM supplier WHERE s_acctbal>1000) AS verified_providers, (SELECT count(*) FROM part WHERE p_type<>'PROMO') AS active_products,
(SELECT count(*) FROM orders WHERE date_trunc('month', o_orderdate)=timestamp '1998-06-01') AS orders_this_month,
(SELECT count(*) FROM lineitem WHERE l_returnflag='R') AS pending_refunds, (SELECT count(*) FROM customer WHERE c_mktsegment='BUILDING') AS active_sponsors""")
def commercial_overview(spark, d):
    m = memberships(spark, d)
    return A.commercial_overview({
        "plans": load(spark, d, "part"), "subscriptions": m, "members": m,
        "providers": load(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 1000, "VERIFIED").otherwise("NEW").alias("verification_status"), F.lit("ACTIVE").alias("status")),
        "products": load(spark, d, "part").select(F.when(F.col("p_type") == "PROMO", "OFF").otherwise("ACTIVE").alias("status")),
        "orders": load(spark, d, "orders").select(F.col("o_orderdate").alias("created_at")),
        "refunds": load(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "REQUESTED").otherwise("DONE").alias("status")),
        "sponsors": load(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "ACTIVE").otherwise("OFF").alias("status")),
    }, NOW)


_RES_SQL = """r AS (SELECT cast(l_shipdate AS date) AS budget_date, l_suppkey AS source_id, CASE l_returnflag WHEN 'A' THEN 'RESERVED' WHEN 'N' THEN 'SETTLED' ELSE 'FAILED' END AS status,
 cast(floor(l_extendedprice/10) AS bigint) AS estimated_tokens, CASE WHEN l_returnflag='A' THEN 0 ELSE cast(floor(l_quantity) AS bigint) END AS actual_tokens FROM lineitem WHERE NOT (l_linestatus='O' AND l_linenumber=1))"""


def reservations(spark, d):
    f = F.col("l_returnflag")
    return load(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("budget_date"), F.col("l_suppkey").alias("source_id"),
        F.when(f == "A", "RESERVED").when(f == "N", "SETTLED").otherwise("FAILED").alias("status"),
        F.floor(F.col("l_extendedprice") / 10).cast("bigint").alias("estimated_tokens"),
        F.when(f == "A", 0).otherwise(F.floor("l_quantity")).cast("bigint").alias("actual_tokens"),
        ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)).alias("budget_exempt"),
    )


@query("budget_usage", f"""WITH {_RES_SQL}, s AS (SELECT *, 'GLOBAL' AS scope_type, cast(0 AS bigint) AS scope_id FROM r UNION ALL SELECT *, 'SOURCE', source_id FROM r)
SELECT budget_date, scope_type, scope_id, count(*) FILTER (status='RESERVED') AS reserved_articles, count(*) FILTER (status='SETTLED') AS settled_articles,
 cast(coalesce(sum(estimated_tokens) FILTER (status='RESERVED'),0) AS bigint) AS reserved_tokens, cast(sum(actual_tokens) AS bigint) AS actual_tokens FROM s GROUP BY 1,2,3""")
def budget_usage(spark, d):
    return A.budget_usage(reservations(spark, d))


@query("latency_percentiles", f"""WITH pj AS {JOBS.sql}, r AS (SELECT stage, elapsed_ms, row_number() OVER (PARTITION BY stage ORDER BY elapsed_ms) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM pj)
SELECT stage, max(n) AS samples, max(elapsed_ms) FILTER (rn = (n*50+99)//100) AS p50, max(elapsed_ms) FILTER (rn=(n*95+99)//100) AS p95, max(elapsed_ms) FILTER (rn=(n*99+99)//100) AS p99, max(elapsed_ms) AS max FROM r GROUP BY 1""")
def latency_percentiles(spark, d):
    return A.latency(JOBS(spark, d), "stage", "elapsed_ms")


@query("assistant_usage", f"""WITH c AS (SELECT conv_id, arg_min(role, turn) AS mode, count(*) FILTER (role='assistant' AND length(text)>400) AS k FROM conversations GROUP BY 1)
SELECT mode, count(*) AS assistant_queries, count(*) FILTER (k>0) AS cited_answers, (floor(count(*) FILTER (k>0)*1000.0/count(*)+0.5)/10.0)::double AS cited_answer_rate FROM c GROUP BY 1""")
def assistant_usage(spark, d):
    c = load(spark, d, "conversations").groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("mode"), F.count_if((F.col("role") == "assistant") & (F.length("text") > 400)).alias("citation_count")
    )
    return A.assistant_usage(c, "mode")


@query("manual_edit_rate", "SELECT (floor(count(*) FILTER (l_returnflag<>l_linestatus)*1000.0/count(*)+0.5)/10.0)::double AS manual_edit_rate FROM lineitem")
def manual_edit_rate(spark, d):
    return A.edit_rate(load(spark, d, "lineitem").select(F.col("l_returnflag").alias("before_snapshot"), F.col("l_linestatus").alias("after_snapshot")))


_POS_SQL = "coalesce(sum(CASE WHEN status IN ('PROCESSING','WAITING_BUDGET','WAITING_APPROVAL') THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)"


def unique_jobs(spark, d):
    """The given lines may repeat an id; keep one row per id."""
    return JOBS(spark, d).groupBy("id").agg(*[F.min(c).alias(c) for c in ("status", "progress", "started_at", "job_type", "elapsed_ms")])


_UJ_SQL = f"u AS (SELECT id, min(status) AS status, min(progress) AS progress, min(started_at) AS started_at, min(job_type) AS job_type, min(elapsed_ms) AS elapsed_ms FROM {JOBS.sql} GROUP BY 1)"


@query("queue_position", f"WITH {_UJ_SQL} SELECT id, cast({_POS_SQL} AS bigint) AS queue_position FROM u")
def queue_position(spark, d):
    return A.queue_position(unique_jobs(spark, d)).select("id", "queue_position")


@query("queue_eta", f"""WITH {_UJ_SQL}, a AS (SELECT avg(elapsed_ms) AS m FROM u WHERE job_type='FULL_PIPELINE' AND started_at > timestamp '1998-05-29 12:00:00'),
p AS (SELECT id, progress, cast({_POS_SQL} AS bigint) AS queue_position FROM u)
SELECT id, queue_position, cast(greatest(0, floor(m*(1.0::double-progress/100.0::double)+0.5)) + CASE WHEN queue_position>0 THEN floor(m+0.5)*queue_position ELSE 0 END AS bigint) AS estimated_ms FROM p, a""")
def queue_eta(spark, d):
    return A.eta(finished(unique_jobs(spark, d)), NOW).select("id", "queue_position", "estimated_ms")


_POSTS_SQL = "SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN 'REPORTED' WHEN 'SMALL' THEN 'HIDDEN' ELSE 'VISIBLE' END AS status, p_name AS content FROM part"


def posts(spark, d):
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "REPORTED").when(F.col("p_type") == "SMALL", "HIDDEN").otherwise("VISIBLE").alias("status"),
        F.col("p_name").alias("content"),
    )


@query("post_counters", f"""WITH p AS ({_POSTS_SQL}), ev AS {EVENTS.sql} SELECT id, status, (SELECT count(*) FROM ev WHERE item_id=p.id AND event_type='LIKE') AS like_count,
(SELECT count(*) FROM ev WHERE item_id=p.id AND event_type='VIEW' AND value>20) AS comment_count,
CASE WHEN status<>'VISIBLE' THEN (SELECT count(*) FROM ev WHERE item_id=p.id AND event_type='REMINDER' AND value>50) END AS report_count FROM p""")
def post_counters(spark, d):
    ev = EVENTS(spark, d).withColumnRenamed("item_id", "post_id")
    comments = ev.where("event_type = 'VIEW'").withColumn("status", F.when(F.col("value") > 20, "VISIBLE").otherwise("HIDDEN"))
    reports = ev.where("event_type = 'REMINDER'").withColumn("status", F.when(F.col("value") > 50, "OPEN").otherwise("RESOLVED"))
    return A.post_counters(posts(spark, d), ev.where("event_type = 'LIKE'"), comments, reports).select("id", "status", "like_count", "comment_count", "report_count")


@query("crawl_rollup", f"WITH jobs AS {CRAWL_JOBS.sql} SELECT source_registry_id, count(*) AS jobs, count(*) FILTER (status IN ('SUCCESS','SUCCEEDED')) AS successes, cast(sum(discovered_count) AS bigint) AS discovered, cast(sum(added_count) AS bigint) AS added FROM jobs GROUP BY 1")
def crawl_rollup(spark, d):
    return A.crawl_rollup(CRAWL_JOBS(spark, d))


_SCHED_SQL = f"reg AS (SELECT *, CASE WHEN s_suppkey>50 THEN timestamp '1998-06-01 12:00:00' + to_hours(cast(floor(daily_token_budget/100) AS int)-50) END AS next_run_at FROM {REGISTRY.sql} JOIN supplier ON s_suppkey=id)"


@query("due_sources", f"WITH {_SCHED_SQL} SELECT id FROM reg WHERE enabled AND allow_auto_crawl AND (next_run_at IS NULL OR next_run_at<=timestamp '{NOW}') ORDER BY id LIMIT 40")
def due_sources(spark, d):
    shift = F.make_dt_interval(hours=(F.floor(F.col("daily_token_budget") / 100) - 50).cast("int"))
    reg = REGISTRY(spark, d).withColumn("next_run_at", F.when(F.col("id") > 50, F.lit(NOW).cast("timestamp_ntz") + shift))
    return P.due_sources(reg, NOW, 40).select("id")


@query("pending_retries", f"WITH jobs AS {CRAWL_JOBS.sql} SELECT id, discovered_at FROM jobs WHERE status='PENDING' AND trigger_type='RETRY' AND discovered_at<=timestamp '{NOW}' ORDER BY discovered_at, id LIMIT 20")
def pending_retries(spark, d):
    return P.pending_retries(CRAWL_JOBS(spark, d), NOW).select("id", "discovered_at")


@query("stale_jobs", f"""WITH pj AS {JOBS.sql}, s AS (SELECT *, status='PROCESSING' AND stage IN ('QUEUED','PREPARING') AND updated_at < timestamp '{NOW}' - INTERVAL 90 MINUTE AS stale FROM pj)
SELECT CASE WHEN stale THEN 'FAILED_RETRYABLE' ELSE status END AS status, CASE WHEN stale THEN 'QUEUE_TIMEOUT_STALE' ELSE stage END AS stage, CASE WHEN stale THEN stage END AS last_failed_stage,
 CASE WHEN stale THEN 'FAILED' END AS document_status, count(*) AS n FROM s GROUP BY ALL""")
def stale_jobs(spark, d):
    return P.mark_stale(JOBS(spark, d), NOW).groupBy("status", "stage", "last_failed_stage", "document_status").agg(F.count("*").alias("n"))


@query("latest_crawl_jobs", f"WITH jobs AS {CRAWL_JOBS.sql} SELECT id, status FROM jobs ORDER BY discovered_at DESC, id DESC LIMIT 200")
def latest_crawl_jobs(spark, d):
    return A.latest(CRAWL_JOBS(spark, d), 200, "discovered_at", "id").select("id", "status")


@query("latest_assistant_events", "SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 100")
def latest_assistant_events(spark, d):
    """The requested number is clamped to 1..100."""
    return A.latest(load(spark, d, "conversations"), 1000, "conv_id", "turn", lo=1, hi=100).select("conv_id", "turn")


_ERR_SQL = f"e AS (SELECT id, source_registry_id, discovered_at AS created_at, CASE WHEN trigger_type='SCHEDULED' THEN discovered_at END AS resolved_at, retry_count, canonical_url AS failed_url, status='FAILED' AS retryable FROM {CRAWL_JOBS.sql})"


def errors(spark, d):
    j = CRAWL_JOBS(spark, d)
    return j.select(
        "id", "source_registry_id", F.col("discovered_at").alias("created_at"),
        F.when(F.col("trigger_type") == "SCHEDULED", F.col("discovered_at")).alias("resolved_at"), "retry_count",
        F.col("canonical_url").alias("failed_url"), (F.col("status") == "FAILED").alias("retryable"),
    )


@query("recent_errors", f"WITH {_ERR_SQL}, reg AS {REGISTRY.sql} SELECT e.id, source_name FROM e JOIN reg ON reg.id=e.source_registry_id WHERE resolved_at IS NULL ORDER BY created_at DESC, e.id DESC LIMIT 10")
def recent_errors(spark, d):
    return J.recent_errors(errors(spark, d), REGISTRY(spark, d)).select("id", "source_name")


@query("backfill_candidates", f"""WITH docs AS {DOCS.sql}, items AS {ITEMS.sql} SELECT d.id, i.status AS publish_status FROM docs d JOIN items i ON i.document_id=d.id
WHERE d.source_type IN ('WEB_ARTICLE','PDF','IMAGE') AND (custom_cover_path IS NULL OR d.cover_image_type='CATEGORY_DEFAULT') AND d.content_kind='SERVICE_NOTICE' AND i.status='PUBLISHED'
AND d.id IN (SELECT document_id FROM {CRAWL_JOBS.sql} WHERE status='SUCCESS') ORDER BY d.id LIMIT 500""")
def backfill_candidates(spark, d):
    jobs = CRAWL_JOBS(spark, d).withColumn("source_registry_id", F.col("status"))
    docs = DOCS(spark, d).drop("document_id", "status")
    return P.backfill_candidates(docs, ITEMS(spark, d), jobs, True, "SUCCESS", "SERVICE_NOTICE", "published").select("id", "publish_status")


@query("organisation_log", """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey=7 ORDER BY l_shipdate DESC, l_orderkey*100000+l_partkey*10+l_linenumber DESC LIMIT 200""")
def organisation_log(spark, d):
    log = load(spark, d, "lineitem").withColumns({"id": F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber"), "created_at": F.col("l_shipdate")})
    return P.for_org(log.withColumn("organization_id", F.col("l_suppkey")), 7).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("document_tabs", f"""WITH docs AS {DOCS.sql} SELECT * FROM (SELECT 'ALL' AS status_group, count(*) AS n FROM docs UNION ALL SELECT 'PENDING', count(*) FROM docs WHERE status IN ('UPLOADED','PROCESSING')
UNION ALL SELECT 'WAITING_REVIEW', count(*) FROM docs WHERE status='WAITING_REVIEW' UNION ALL SELECT 'WAITING_PUBLISH', count(*) FROM docs WHERE status='REVIEWED'
UNION ALL SELECT 'PUBLISHED', count(*) FROM docs WHERE status='PUBLISHED' UNION ALL SELECT 'EXCEPTION', count(*) FROM docs WHERE status IN ('FAILED','WITHDRAWN'))""")
def document_tabs(spark, d):
    return P.status_groups(DOCS(spark, d))


@query("todo_list", f"""WITH docs AS {DOCS.sql} SELECT id, CASE status WHEN 'FAILED' THEN 1 WHEN 'WAITING_REVIEW' THEN 2 ELSE 3 END AS todo_rank,
CASE status WHEN 'FAILED' THEN '需要关注' WHEN 'WAITING_REVIEW' THEN '待审核' ELSE '待发布' END AS priority,
CASE WHEN status='FAILED' THEN '处理没有完成，原文件仍已保留。' WHEN status='WAITING_REVIEW' AND source_type='WEB_ARTICLE' THEN '请核对来源、封面和正文依据。'
 WHEN status='WAITING_REVIEW' THEN 'AI 结果已生成，请对照原文确认。' ELSE '审核已完成，请预览用户端效果后发布。' END AS reason
FROM docs WHERE status IN ('FAILED','WAITING_REVIEW','REVIEWED')""")
def todo_list(spark, d):
    return P.todo(DOCS(spark, d)).select("id", "todo_rank", "priority", "reason")


@query("audit_log_search", f"WITH ev AS {EVENTS.sql} SELECT event_id FROM ev WHERE contains(visitor_id || event_type || 'ITEM' || cast(item_id AS string), '4LI') AND starts_with(cast(ts AS string), '2024-01-1')")
def audit_log_search(spark, d):
    log = EVENTS(spark, d).withColumnsRenamed({"visitor_id": "operator_name", "event_type": "action", "item_id": "target_id"}).withColumn("target_type", F.lit("ITEM"))
    return P.search_log(log, " 4LI ", "2024-01-1").select("event_id")


@query("queue_owners", f"""WITH q AS {JOBS.sql}, reg AS {REGISTRY.sql} SELECT q.id, q.document_id, source_name, c_nationkey AS organization_id, n_name AS organization_name FROM q
LEFT JOIN reg ON reg.id=q.source_id AND reg.enabled JOIN orders ON o_orderkey=q.document_id JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey""")
def queue_owners(spark, d):
    q = JOBS(spark, d).select("id", "document_id", F.col("source_id").alias("source_registry_id"))
    docs = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("created_by"))
    users = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("organization_id"))
    orgs = load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    out = J.queue_owner(q, docs, users, orgs, REGISTRY(spark, d).where("enabled"))
    return out.select("id", "document_id", "source_name", "organization_id", "organization_name")


@query("owning_source", f"""WITH jobs AS {CRAWL_JOBS.sql}, l AS (SELECT document_id, arg_max(duration_ms, id) AS v FROM jobs GROUP BY 1), reg AS {REGISTRY.sql}
SELECT c_custkey AS id, source_name, nationkey FROM customer JOIN l ON l.document_id=c_custkey JOIN reg ON reg.id=(l.v+100000)//5000""")
def owning_source(spark, d):
    jobs = CRAWL_JOBS(spark, d).withColumn("source_registry_id", F.floor((F.col("duration_ms") + 100000) / 5000))
    docs = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return J.owning_source(docs, jobs, REGISTRY(spark, d), ["source_name", "nationkey"]).select("id", "source_name", "nationkey")


@query("source_status", f"WITH reg AS {REGISTRY.sql} SELECT id, source_name, enabled FROM reg")
def source_status(spark, d):
    reg = REGISTRY(spark, d).withColumn("last_crawled_at", F.lit(None).cast("timestamp_ntz"))
    return A.source_status(reg).select("id", "source_name", "enabled")


@query("job_outcomes", f"""WITH jobs AS {CRAWL_JOBS.sql}, e AS (SELECT *, greatest(failed_count, CASE WHEN retry_count=5 THEN 2 ELSE 0 END) AS failed FROM jobs)
SELECT id, failed, CASE WHEN failed=0 THEN 'SUCCESS' WHEN added_count+duplicate_count+skipped_count>0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS outcome FROM e""")
def job_outcomes(spark, d):
    from ..functions.jobs import job_outcome

    jobs = CRAWL_JOBS(spark, d).withColumn("failures", F.when(F.col("retry_count") == 5, 2).otherwise(0))
    return jobs.select("id", job_outcome("added_count", "duplicate_count", "skipped_count", "failed_count", "failures").alias("o")).select("id", F.col("o.failed_count").alias("failed"), F.col("o.status").alias("outcome"))


@query("version_chain", f"""WITH jobs AS {CRAWL_JOBS.sql} SELECT id, source_registry_id AS root_id, row_number() OVER w + CASE WHEN source_registry_id<100 THEN 2 ELSE 0 END AS version_no,
coalesce(lag(id) OVER w, CASE WHEN source_registry_id<100 THEN -source_registry_id END) AS previous_version_id, lead(id) OVER w IS NOT NULL AS superseded FROM jobs WINDOW w AS (PARTITION BY source_registry_id ORDER BY id)""")
def version_chain(spark, d):
    docs = CRAWL_JOBS(spark, d).select("id", F.col("source_registry_id").alias("root_id"))
    base = REGISTRY(spark, d).where("id < 100").select(F.col("id").alias("root_id"), F.lit(2).cast("bigint").alias("max_version"), (-F.col("id")).alias("last_id"))
    return W.assign_versions(docs, base=base)


_IMG_SQL = """im AS (SELECT l_orderkey AS document_id, l_orderkey*100000+l_partkey*10+l_linenumber AS id, l_linenumber AS pos, concat('https://', CASE WHEN l_partkey<100 THEN 'logo.' ELSE 'img.' END, 'example.org/', cast(l_partkey AS string)) AS url,
 cast(floor(l_quantity*40) AS int) AS width, cast(floor(l_extendedprice/80) AS int) AS height, l_linestatus AS caption, CASE l_returnflag WHEN 'A' THEN 'VALID' WHEN 'N' THEN '' ELSE 'BROKEN' END AS candidate_status,
 cast(floor(l_discount*100) AS int) AS relevance_score FROM lineitem)"""


def images(spark, d):
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("https://"), F.when(F.col("l_partkey") < 100, "logo.").otherwise("img."), F.lit("example.org/"), F.col("l_partkey").cast("string")).alias("url"),
        F.floor(F.col("l_quantity") * 40).cast("int").alias("width"), F.floor(F.col("l_extendedprice") / 80).cast("int").alias("height"),
        F.col("l_linestatus").alias("caption"),
        F.when(F.col("l_returnflag") == "A", "VALID").when(F.col("l_returnflag") == "N", "").otherwise("BROKEN").alias("candidate_status"),
        F.floor(F.col("l_discount") * 100).cast("int").alias("relevance_score"),
    )


_GATED_SQL = _IMG_SQL + """, g AS (SELECT * FROM im WHERE candidate_status IN ('','VALID') AND width>=600 AND height>=250 AND width::double/height BETWEEN 0.75 AND 2.4 AND NOT contains(url, 'logo')),
one AS (SELECT document_id, url, min(pos) AS pos FROM g GROUP BY 1,2)"""


@query("usable_images", f"WITH {_GATED_SQL} SELECT document_id, url, pos FROM one")
def usable_images(spark, d):
    return P.gate_images(images(spark, d)).select("document_id", "url", "pos")


_UIMG_SQL = _IMG_SQL + ", u AS (SELECT document_id, id, min(pos) AS pos, max(relevance_score) AS relevance_score, min(candidate_status) AS candidate_status FROM im GROUP BY 1,2)"


def unique_images(spark, d):
    return images(spark, d).groupBy("document_id", "id").agg(F.min("pos").alias("pos"), F.max("relevance_score").alias("relevance_score"), F.min("candidate_status").alias("candidate_status"))


@query("ranked_images", f"""WITH {_UIMG_SQL} SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY pos, id) AS priority_rank,
row_number() OVER (PARTITION BY document_id ORDER BY relevance_score DESC, pos, id) AS list_rank, row_number() OVER (PARTITION BY document_id ORDER BY relevance_score DESC, pos, id)=1 AS best FROM u""")
def ranked_images(spark, d):
    return W.rank_images(unique_images(spark, d)).select("document_id", "id", "priority_rank", "list_rank", "best")


@query("auto_approved_images", f"""WITH {_UIMG_SQL}, r AS (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY relevance_score DESC, pos, id) AS rn FROM u JOIN orders ON o_orderkey=document_id
WHERE candidate_status='VALID' AND o_orderstatus='F' AND o_totalprice>100000) SELECT document_id, id FROM r WHERE rn=1""")
def auto_approved_images(spark, d):
    im = unique_images(spark, d).withColumns({"priority_rank": F.col("pos"), "review_status": F.when(F.col("candidate_status") == "VALID", "PENDING").otherwise("IGNORED")})
    pol = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") == "F").alias("auto_approve_images"), F.lit(True).alias("image_cache_allowed"),
        F.col("o_orderdate").alias("image_policy_reviewed_at"), F.when(F.col("o_totalprice") > 100000, "owned").otherwise(" ").alias("image_usage_basis"),
    )
    return W.auto_approve(im, pol).select("document_id", "id")
