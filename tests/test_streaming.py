"""Streams end in the state of their batch twins."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import budget as B
from noticeboard.streaming import jobs as S

T0 = dt.datetime(2026, 7, 1)
KINDS = ["VIEW", "LIKE", "FAVORITE", "REMINDER", "CONTENT_LISTEN"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Files in event order, one per micro-batch."""
    path = str(tmp_path_factory.mktemp("events"))
    rows = [(i, T0 + dt.timedelta(hours=3 * i), i * 7 % 5, i * 3 % 4, KINDS[i * 11 % 5]) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, item_id long, event_type string")
    for k in range(3):
        df.where(f"event_id >= {30 * k} and event_id < {30 * k + 30}").coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    return df, path


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def final(spark, out, mode, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("job", [S.rolling_engagement, S.daily_metrics])
def test_windows(spark, events, tmp_path, job):
    df, path = events
    same(final(spark, job(stream(spark, df, path)), "complete", tmp_path, f"w_{job.__name__}"), job(df))


def test_keyed_aggregates(spark, events, tmp_path):
    df, path = events
    toggles = lambda e: e.withColumn("is_on", F.col("event_type") != "LIKE")
    same(final(spark, S.toggle_state(toggles(stream(spark, df, path))), "complete", tmp_path, "toggles"), S.toggle_state(toggles(df)))
    reminders = lambda e: e.withColumns({"reminder_type": F.when(F.col("event_id") % 2 == 0, "DEADLINE").otherwise("OTHER"), "remind_at": F.col("ts")})
    out = S.latest_reminder(reminders(df))
    assert out.where("reminder_type = 'OTHER'").count() == 0 and out.count() == 10
    same(final(spark, S.latest_reminder(reminders(stream(spark, df, path))), "complete", tmp_path / "r", "reminders"), out)


def test_moderation(spark, events, tmp_path):
    df, path = events

    def actions(e):
        kind = F.when(F.col("event_type") == "VIEW", "HIDDEN").when(F.col("event_type") == "LIKE", "VISIBLE").otherwise("REPORT")
        return e.select(F.col("item_id").alias("post_id"), "ts", "event_id", kind.alias("action"))

    got = final(spark, S.moderation_state(actions(stream(spark, df, path))), "update", tmp_path, "moderation")
    # update mode appends the state after each batch to the memory table: the last one has been written last
    last = {}
    for r in got.collect():
        last[r.post_id] = tuple(r)
    assert sorted(last.values()) == sorted(map(tuple, S.moderation_twin(actions(df)).collect()))


def test_overdue(spark, tmp_path):
    rows = [(1, 0, "PROCESSING", "QUEUED"), (2, 0, "PROCESSING", "QUEUED"), (3, 0, "PROCESSING", "REWRITE"), (2, 60, "PROCESSING", "QUEUED"),
            (4, 70, "PROCESSING", "PREPARING"), (4, 80, "SUCCEEDED", "PREPARING"), (5, 100, "PROCESSING", "QUEUED"), (9, 140, "SUCCEEDED", "x"), (9, 200, "SUCCEEDED", "x")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), s, g) for i, m, s, g in rows], "id long, updated_at timestamp, status string, stage string")
    path = str(tmp_path / "in")
    for k, m in enumerate((0, 60, 100, 140, 200)):
        nxt = (60, 100, 140, 200, 999)[k]
        lo, hi = T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=nxt)
        df.where((F.col("updated_at") >= F.lit(lo)) & (F.col("updated_at") < F.lit(hi))).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    got = final(spark, S.overdue(S.heartbeats(stream(spark, df, path))), "append", tmp_path, "overdue")
    twin = S.overdue_twin(S.heartbeats(df), F.lit(T0 + dt.timedelta(minutes=200)))
    assert {r.id for r in twin.collect()} == {1, 2, 5}
    same(got, twin)


def test_sinks(spark, events, tmp_path):
    df, path = events
    S.write_days(S.daily_metrics(stream(spark, df, path)), str(tmp_path / "days"), str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination(120)
    same(spark.read.parquet(str(tmp_path / "days")).select("metric_date", "events", "views"), S.daily_metrics(df).select("metric_date", "events", "views"))
    jobs = spark.createDataFrame([], "source_registry_id long, canonical_url string, status string")
    src = spark.createDataFrame([(i, 3) for i in range(5)], "source_registry_id long, max_retries int")

    def errors(e):
        return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_registry_id"), F.col("event_id").cast("string").alias("failed_url"),
                        (F.col("event_type") == "VIEW").alias("retryable"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("resolved_at"))

    def step(batch):
        return B.schedule_retries(batch, jobs, src, T0)

    S.apply_batches(errors(stream(spark, df, path)), step, str(tmp_path / "retries"), str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
    same(spark.read.parquet(str(tmp_path / "retries")).drop("batch"), step(errors(df)))


def in_batches(df, path, parts):
    """One file, and so one micro-batch, per list of row numbers."""
    for k, rows in enumerate(parts):
        df.where(F.col("event_id").isin(rows)).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")


def last_rows(got, n):
    last = {}
    for r in got.collect():
        last[tuple(r)[:n]] = tuple(r)
    return sorted(last.values())


def test_late_moderation(spark, tmp_path):
    """Decisions and reports in the wrong micro-batch, within the lateness."""
    h = dt.timedelta(hours=1)
    rows = [(1, 0, "REPORT"), (2, 1, "HIDDEN"), (3, 2, "REPORT"), (4, 3, "REPORT"), (5, 2, "VISIBLE"), (6, 0, "REPORT"), (7, 9, "REPORT"), (8, 30, "REPORT")]
    df = spark.createDataFrame([(i, T0 + k * h, i % 2, a) for i, k, a in rows] + [(9, T0 + 31 * h, 0, "HIDDEN")], "event_id long, ts timestamp, post_id long, action string")
    in_batches(df, str(tmp_path / "in"), [[4, 7, 3], [2, 1, 6], [5], [8], [9]])
    got = final(spark, S.moderation_state(stream(spark, df, str(tmp_path / "in"))), "update", tmp_path, "late_moderation")
    assert last_rows(got, 1) == sorted(map(tuple, S.moderation_twin(df).collect()))


def test_overdue_ties(spark, tmp_path):
    """Equal times: the open event counts, whatever order they arrive in; a late event does not reopen a closed key."""
    m = dt.timedelta(minutes=1)
    rows = [(1, 1, 0, True, 30), (2, 1, 0, False, 30), (3, 2, 0, False, 30), (4, 2, 0, True, 40), (5, 3, 5, False, 60), (6, 3, 1, True, 31), (7, 9, 50, False, 90), (8, 9, 80, False, 99)]
    df = spark.createDataFrame([(i, k, T0 + t * m, o, T0 + d * m) for i, k, t, o, d in rows], "event_id long, id long, ts timestamp, is_open boolean, deadline timestamp")
    in_batches(df, str(tmp_path / "in"), [[1, 3, 5], [2, 4, 6], [7], [8]])
    got = final(spark, S.overdue(stream(spark, df, str(tmp_path / "in")).drop("event_id"), "10 minutes"), "append", tmp_path, "ties")
    twin = S.overdue_twin(df, F.lit(T0 + 70 * m))
    assert {r.id for r in twin.collect()} == {1, 2}
    same(got, twin)


def test_toggles_leave_the_state(spark, tmp_path):
    day = dt.timedelta(days=1)
    rows = [(1, 0, 1, True), (2, 1, 2, True), (3, 0, 1, False), (4, 60, 3, True), (5, 62, 4, False), (6, 63, 4, True)]
    df = spark.createDataFrame([(i, T0 + k * day, u, 7, o) for i, k, u, o in rows], "event_id long, ts timestamp, user_id long, item_id long, is_on boolean")
    in_batches(df, str(tmp_path / "in"), [[1, 2], [3], [4], [5], [6]])
    q = S.toggle_stream(stream(spark, df, str(tmp_path / "in")), horizon_days=30).writeStream.format("memory").queryName("toggles_end").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows_held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows_held) >= 3 and rows_held[-1] == 2  # users 1 and 2 have gone
    got = {(r.user_id, r.item_id): r.is_on for r in spark.table("toggles_end").orderBy("changed_at").collect()}
    assert got == {(r.user_id, r.item_id): r.is_on for r in S.toggle_state(df).collect()}


def test_budget_ledger_over_batches(spark, tmp_path):
    rows = [(i, i % 3, i % 4, "x" * (4 + 36 * (i % 5 == 0)), f"h{i % 17}", True, T0 + dt.timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "queue_id long, source_id long, task_root_id long, text string, content_hash string, approved boolean, created_at timestamp_ntz")
    sources = spark.createDataFrame([(1, 4, 0, True), (2, 0, 60, True)], "source_id long, daily_article_budget int, daily_token_budget int, allow_auto_ai boolean")
    limits = {"global_articles": 14, "global_tokens": 150, "per_task": 5}
    path, out = str(tmp_path / "in"), str(tmp_path / "ledger")
    for k, (a, z) in enumerate(((0, 11), (11, 12), (12, 40))):
        df.where(F.col("queue_id").between(a, z - 1)).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    for _ in range(2):  # the second run finds nothing new
        S.reserve_stream(stream(spark, df, path), sources, out, str(tmp_path / "cp"), **limits).trigger(availableNow=True).start().awaitTermination(300)
    whole = B.reserve_budget(df, sources, **limits)
    same(spark.read.parquet(out).select("queue_id", "status", "reason_code"), whole.select("queue_id", "status", "reason_code"))
