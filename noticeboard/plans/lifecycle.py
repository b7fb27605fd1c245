"""Queues, budgets and the batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import budget as B
from ..sources.tables import load
from ..streaming import jobs as S
from .registry import EVENTS, JOBS, REGISTRY, query
from .textual import sq, strip


# ------------------------------------------------------------------- streams --
@query("rolling_engagement", f"""WITH ev AS {EVENTS.sql}, w AS (SELECT item_id, event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM ev)
SELECT s AS window_start, s + INTERVAL 7 DAY AS window_end, item_id, count(*) FILTER (event_type='VIEW') AS views, count(*) FILTER (event_type='CONTENT_LISTEN') AS listens FROM w GROUP BY 1,2,3""")
def rolling_engagement(spark, d):
    return S.rolling_engagement(EVENTS(spark, d))


@query("daily_metrics", f"WITH ev AS {EVENTS.sql} SELECT cast(ts AS date) AS metric_date, count(*) AS events, count(*) FILTER (event_type='VIEW') AS views, count(*) FILTER (event_type='LIKE') AS likes, count(*) FILTER (event_type='FAVORITE') AS favorites, count(*) FILTER (event_type='REMINDER') AS reminders, count(*) FILTER (event_type='CONTENT_LISTEN') AS listens FROM ev GROUP BY 1")
def daily_metrics(spark, d):
    return S.daily_metrics(EVENTS(spark, d))


@query("toggle_states", f"WITH ev AS {EVENTS.sql} SELECT user_id, item_id, arg_max(event_type<>'LIKE', struct_pack(t := ts, e := event_id)) AS is_on, max(ts) AS changed_at FROM ev GROUP BY 1,2")
def toggle_states(spark, d):
    return S.toggle_state(EVENTS(spark, d).withColumn("is_on", F.col("event_type") != "LIKE"))


@query("latest_reminders", f"WITH ev AS {EVENTS.sql} SELECT user_id, item_id, 'DEADLINE' AS reminder_type, arg_max(ts + to_hours(cast(event_id%50 AS int)), struct_pack(t := ts, e := event_id)) AS remind_at FROM ev WHERE event_type='REMINDER' GROUP BY 1,2")
def latest_reminders(spark, d):
    ev = EVENTS(spark, d).withColumns({
        "reminder_type": F.when(F.col("event_type") == "REMINDER", "DEADLINE").otherwise("SOMETHING"), "remind_at": F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 50).cast("int")),
    })
    return S.latest_reminder(ev)


@query("moderation_states", f"""WITH ev AS {EVENTS.sql}, a AS (SELECT item_id AS post_id, ts, event_id, CASE event_type WHEN 'VIEW' THEN 'REPORT' WHEN 'LIKE' THEN 'HIDDEN' WHEN 'FAVORITE' THEN 'VISIBLE' END AS action FROM ev WHERE event_type IN ('VIEW','LIKE','FAVORITE')),
d AS (SELECT *, max(CASE WHEN action<>'REPORT' THEN struct_pack(t := ts, e := event_id) END) OVER (PARTITION BY post_id) AS dec FROM a)
SELECT post_id, CASE arg_max(action, struct_pack(t := ts, e := event_id)) WHEN 'REPORT' THEN 'REPORTED' ELSE arg_max(action, struct_pack(t := ts, e := event_id)) END AS status, count(*) FILTER (action='REPORT' AND (dec IS NULL OR struct_pack(t := ts, e := event_id) > dec)) AS open_reports FROM d GROUP BY 1""")
def moderation_states(spark, d):
    e = F.col("event_type")
    actions = EVENTS(spark, d).where(e.isin("VIEW", "LIKE", "FAVORITE")).select(
        F.col("item_id").alias("post_id"), "ts", "event_id", F.when(e == "VIEW", "REPORT").when(e == "LIKE", "HIDDEN").otherwise("VISIBLE").alias("action")
    )
    return S.moderation_twin(actions)


@query("overdue_jobs", f"""WITH j AS {JOBS.sql}, l AS (SELECT document_id AS id, bool_or(status='PROCESSING' AND stage='QUEUED') FILTER (updated_at=m) AS is_open, max(updated_at) AS last_at FROM (SELECT *, max(updated_at) OVER (PARTITION BY document_id) AS m FROM j) GROUP BY 1)
SELECT id, last_at + INTERVAL 90 MINUTE AS deadline FROM l WHERE is_open AND last_at + INTERVAL 90 MINUTE < timestamp '1998-06-01'""")
def overdue_jobs(spark, d):
    """Documents whose last heartbeat left them waiting, more than 90 minutes before the moment looked at; of equal times the waiting one counts."""
    ev = S.heartbeats(JOBS(spark, d).withColumn("id", F.col("document_id")))
    return S.overdue_twin(ev, F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))


# -------------------------------------------------------------- queue, budget --
def requests(spark, d):
    """One processing request per document: sources by number, five documents a minute."""
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("queue_id"), (F.col("doc_id") % 50 + 1).alias("source_id"), F.floor(F.col("doc_id") / 40).alias("task_root_id"), "text", T.content_hash("text").alias("content_hash"),
        (F.col("lang") == "fr").alias("approved"), (F.lit("2026-07-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("doc_id") * 17).cast("int"))).alias("created_at"),
    )


# the published rules one request after the other; held are the requests admitted so far
_ADMISSION_SQL = f"""WITH RECURSIVE g AS (SELECT doc_id AS q, doc_id%50+1 AS s, doc_id//40 AS task, sha256({sq('text')}) AS h, timestamp '2026-07-01' + to_minutes(cast(doc_id*17 AS int)) AS made, length(text)>12000 AS long,
 CASE WHEN {strip('text')}='' THEN 0 ELSE greatest(1, cast(ceil(length(text)/2.0) AS bigint)) END AS est, lang='fr' AS approved FROM documents),
r AS MATERIALIZED (SELECT g.*, cast(made + INTERVAL 8 HOUR AS date) AS day, NOT approved AND NOT coalesce(allow_auto_ai, false) AS bare, daily_article_budget+1 AS sa, daily_token_budget*4 AS st, row_number() OVER (ORDER BY made, q) AS i FROM g LEFT JOIN {REGISTRY.sql} reg ON reg.id=g.s),
walk(i, reason, held) AS (SELECT cast(0 AS bigint), cast(NULL AS varchar), cast([] AS STRUCT(h varchar, task bigint, day date, s bigint, est bigint)[])
 UNION ALL SELECT i, reason, CASE WHEN reason IS NULL THEN list_append(held, struct_pack(h := h, task := task, day := day, s := s, est := est)) ELSE held END FROM (
  SELECT *, CASE WHEN long THEN 'INPUT_TOO_LONG' WHEN len(list_filter(held, lambda x: x.h=h))>0 THEN 'CONTENT_HASH_DUPLICATE' WHEN len(list_filter(held, lambda x: x.task=task))>=20 THEN 'TASK_ARTICLE_LIMIT'
   WHEN len(today)>=60 THEN 'BUDGET_ARTICLES' WHEN coalesce(list_sum(list_transform(today, lambda x: x.est)), 0)+est>60000 THEN 'BUDGET_TOKENS' WHEN bare THEN 'SOURCE_APPROVAL_REQUIRED'
   WHEN sa>0 AND len(list_filter(today, lambda x: x.s=s))>=sa THEN 'BUDGET_ARTICLES' WHEN st>0 AND coalesce(list_sum(list_transform(list_filter(today, lambda x: x.s=s), lambda x: x.est)), 0)+est>st THEN 'BUDGET_TOKENS' END AS reason
  FROM (SELECT r.*, held, list_filter(held, lambda x: x.day=r.day) AS today FROM walk JOIN r ON r.i=walk.i+1))),
o AS (SELECT r.*, reason, CASE WHEN reason IS NULL THEN 'RESERVED' WHEN reason='SOURCE_APPROVAL_REQUIRED' THEN 'WAITING_APPROVAL' WHEN reason='CONTENT_HASH_DUPLICATE' THEN 'DUPLICATE' ELSE 'WAITING_BUDGET' END AS status FROM r JOIN walk USING (i))
SELECT q AS queue_id, day AS budget_date, est AS estimated_tokens, status, reason AS reason_code, CASE WHEN status='WAITING_BUDGET' THEN cast(day + 1 AS timestamp) - INTERVAL 8 HOUR END AS available_at FROM o"""


@query("budget_decisions", _ADMISSION_SQL)
def budget_decisions(spark, d):
    """Ordered admission under limits of task, day and source at once."""
    sources = REGISTRY(spark, d).select("source_id", (F.col("daily_article_budget") + 1).alias("daily_article_budget"), (F.col("daily_token_budget") * 4).alias("daily_token_budget"), "allow_auto_ai")
    out = B.reserve_budget(requests(spark, d), sources, global_articles=60, global_tokens=60000, per_task=20, zone="Asia/Shanghai")
    return out.select("queue_id", "budget_date", "estimated_tokens", "status", "reason_code", "available_at")


@query("unlimited_budget_decisions", f"""WITH r AS (SELECT doc_id AS queue_id, text, lang, sha256({sq('text')}) AS h, doc_id%50+1 AS s FROM documents), g AS (SELECT r.*, length(text)>12000 AS long, lang<>'fr' AND NOT coalesce(allow_auto_ai,false) AS bare FROM r LEFT JOIN {REGISTRY.sql} reg ON reg.id=r.s),
f AS (SELECT h, min(queue_id) AS q FROM g WHERE NOT long AND NOT bare GROUP BY 1)
SELECT queue_id, CASE WHEN long THEN 'INPUT_TOO_LONG' WHEN f.q < queue_id THEN 'CONTENT_HASH_DUPLICATE' WHEN bare THEN 'SOURCE_APPROVAL_REQUIRED' END AS reason_code FROM g LEFT JOIN f USING (h)""")
def unlimited_budget_decisions(spark, d):
    """Without limits only length, copies and approvals decide."""
    sources = REGISTRY(spark, d).select("source_id", F.lit(0).alias("daily_article_budget"), F.lit(0).alias("daily_token_budget"), "allow_auto_ai")
    return B.reserve_budget(requests(spark, d), sources).select("queue_id", "reason_code")


@query("queue_admission", f"""WITH r AS (SELECT doc_id AS q, sha256({sq('text')}) AS h, lang FROM documents), n AS (SELECT h, min(q) FILTER (lang<>'es') AS f, min(q) FILTER (lang='es') AS k FROM r GROUP BY 1)
SELECT q AS queue_id, CASE WHEN coalesce(k, f)<>q THEN coalesce(k, f) END AS existing_id, CASE WHEN coalesce(k, f)<>q THEN 'DUPLICATE' ELSE 'QUEUED' END AS status FROM r JOIN n USING (h) WHERE lang<>'es'""")
def queue_admission(spark, d):
    docs = requests(spark, d).join(load(spark, d, "documents").select(F.col("doc_id").alias("queue_id"), "lang"), "queue_id")
    out = B.admit_queue(docs.where("lang <> 'es'"), docs.where("lang = 'es'").select("queue_id", "content_hash"), True, "2026-07-01 00:00:00")
    return out.select("queue_id", "existing_id", "status")


@query("reconciled_queue", f"""WITH j AS {JOBS.sql}, r AS {REGISTRY.sql} SELECT CASE WHEN ok THEN 'QUEUED' ELSE status END AS status, ok AS requeued, count(*) AS n FROM (SELECT j.status, j.status='WAITING_BUDGET' AND (j.stage='QUEUED' OR coalesce(r.enabled AND r.allow_auto_ai, false)) AS ok FROM j LEFT JOIN r ON r.id=j.source_id) GROUP BY 1,2""")
def reconciled_queue(spark, d):
    q = JOBS(spark, d).withColumn("approved_at", F.when(F.col("stage") == "QUEUED", F.col("started_at")))
    return B.reconcile(q, REGISTRY(spark, d), True).groupBy("status", "requeued").agg(F.count("*").alias("n"))


@query("settled_reservations", "SELECT o_orderkey AS queue_id, CASE o_orderstatus WHEN 'F' THEN 'SETTLED' WHEN 'O' THEN 'FAILED' ELSE 'RESERVED' END AS status, cast(CASE WHEN o_orderstatus='P' THEN 0 ELSE greatest(0, floor(o_totalprice)-100000) END AS bigint) AS actual_tokens FROM orders")
def settled_reservations(spark, d):
    o = load(spark, d, "orders")
    res = o.select(F.col("o_orderkey").alias("queue_id"), F.lit("RESERVED").alias("status"))
    done = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("queue_id"), (F.col("o_orderstatus") == "F").alias("success"), (F.floor("o_totalprice") - 100000).alias("actual_tokens"))
    return B.settle(res, done)


@query("payment_sessions", """SELECT o_orderkey AS session_id, CASE WHEN o_orderstatus='F' AND o_orderdate + INTERVAL 10 MINUTE <= timestamp '1998-06-01' THEN 'SUCCESS' WHEN o_orderdate + INTERVAL 15 MINUTE < timestamp '1998-06-01' THEN 'EXPIRED' ELSE 'PENDING' END AS status,
CASE WHEN o_orderstatus='F' AND o_orderdate + INTERVAL 10 MINUTE <= timestamp '1998-06-01' THEN o_orderdate + INTERVAL 10 MINUTE + to_days(30*cast(substr(o_orderpriority,1,1) AS int)) END AS membership_expires_at FROM orders""")
def payment_sessions(spark, d):
    """Status F confirms in time, status O too late, P never."""
    o, s = load(spark, d, "orders"), F.col("o_orderstatus")
    sessions = o.select(F.col("o_orderkey").alias("session_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("plan_id"), F.lit("PENDING").alias("status"), (F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(15))).alias("expires_at"))
    confirmed = o.where(s != "P").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderdate") + F.make_dt_interval(mins=F.when(s == "F", 10).otherwise(20))).alias("confirmed_at"))
    plans = o.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("plan_id")).distinct().withColumn("duration_days", F.col("plan_id") * 30)
    return B.expire_sessions(sessions, confirmed, plans, "1998-06-01 00:00:00").select("session_id", "status", "membership_expires_at")
