"""Structured Streaming jobs.  Each has a batch twin (the same function on a static frame, or the
named operator) that its final state equals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import vocab as V
from ..operators.budget import reserve_budget, usage_of


# -------------------------------------------------------- declarative aggregates --
def rolling_engagement(events: DataFrame, lateness: str = "1 day", span: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Views and listens per item over the trailing days (sliding event-time windows)."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(F.window("ts", span, slide).alias("w"), "item_id").agg(
        F.count_if(F.col("event_type") == "VIEW").alias("views"), F.count_if(F.col("event_type") == "CONTENT_LISTEN").alias("listens")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "item_id", "views", "listens")


def daily_metrics(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One row per day: events, visitors' actions by type."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    kinds = {"views": "VIEW", "likes": "LIKE", "favorites": "FAVORITE", "reminders": "REMINDER", "listens": "CONTENT_LISTEN"}
    return timed.groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("events"), *[F.count_if(F.col("event_type") == t).alias(n) for n, t in kinds.items()]
    ).select(F.col("w.start").cast("date").alias("metric_date"), "events", *kinds)


def toggle_state(actions: DataFrame) -> DataFrame:
    """On or off per (user, item): the last action counts, repeating it changes nothing."""
    last = F.max_by("is_on", F.struct("ts", "event_id"))
    return actions.groupBy("user_id", "item_id").agg(last.alias("is_on"), F.max("ts").alias("changed_at"))


def latest_reminder(requests: DataFrame, types=None) -> DataFrame:
    """The last requested time per (user, item, type); other types are ignored."""
    known = requests.where(F.col("reminder_type").isin(types or V.REMINDER_TYPES))
    return known.groupBy("user_id", "item_id", "reminder_type").agg(F.max_by("remind_at", F.struct("ts", "event_id")).alias("remind_at"))


def admitted_once(requests: DataFrame, lateness: str = "7 days") -> DataFrame:
    """The first request of each text within the watermark (queue admission on a stream)."""
    return requests.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["content_hash"])


# ------------------------------------------------------------------ keyed state --
DAY_MS = 86_400_000


def _micros(times: pd.Series) -> list[int]:
    return pd.to_datetime(times).astype("datetime64[us]").astype("int64").tolist()


def _fold_latest(names: list[str], changed: str, value: str, horizon_days: int):
    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else None
        for batch in batches:
            for at, event, v in zip(_micros(batch["ts"]), batch["event_id"].tolist(), batch[value].tolist()):
                v = pd.Timestamp(v).value // 1000 if isinstance(v, pd.Timestamp) else int(v)
                if known is None or (at, event) > tuple(known[:2]):
                    known = (at, event, v)
        state.update(known)
        state.setTimeoutTimestamp(max(known[0] // 1000 + horizon_days * DAY_MS, state.getCurrentWatermarkMs() + 1))
        out = dict(zip(names, ([k] for k in key))) | {changed: [pd.Timestamp(known[0], unit="us")]}
        yield pd.DataFrame(out | {value: [pd.Timestamp(known[2], unit="us") if value == "remind_at" else bool(known[2])]})

    return fold


def _latest_stream(events: DataFrame, keys: list[str], value: str, kind: str, lateness: str, horizon_days: int) -> DataFrame:
    fields = [events.schema[k].simpleString().replace(":", " ", 1) for k in keys]
    return events.withWatermark("ts", lateness).groupBy(*keys).applyInPandasWithState(
        _fold_latest(keys, "changed_at", value, horizon_days), ", ".join([*fields, "changed_at timestamp", f"{value} {kind}"]), "ts long, event_id long, value long", "update", "EventTimeTimeout"
    )


def toggle_stream(actions: DataFrame, lateness: str = "1 day", horizon_days: int = 90) -> DataFrame:
    """toggle_state on a stream whose state ends: a toggle that has not been touched for the horizon leaves it (its last row stays in the sink)."""
    return _latest_stream(actions, ["user_id", "item_id"], "is_on", "boolean", lateness, horizon_days)


def reminder_stream(requests: DataFrame, types=None, lateness: str = "1 day", horizon_days: int = 90) -> DataFrame:
    """latest_reminder on a stream whose state ends after the horizon."""
    known = requests.where(F.col("reminder_type").isin(types or V.REMINDER_TYPES))
    return _latest_stream(known, ["user_id", "item_id", "reminder_type"], "remind_at", "timestamp", lateness, horizon_days)


def _fold_posts(horizon_days: int):
    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # time, number and outcome of the last decision; reports after it: those a late decision may still follow, and a count of the rest
        at, number, outcome, settled, times, numbers, newest = state.get if state.exists else (-(1 << 62), 0, "VISIBLE", 0, [], [], 0)
        watermark = state.getCurrentWatermarkMs() * 1000
        reports = set(zip(times, numbers))
        events = pd.concat(list(batches), ignore_index=True)
        for t, e, action in zip(_micros(events["ts"]), events["event_id"].tolist(), events["action"].tolist()):
            if t < watermark:
                continue  # later than the promised lateness
            newest = max(newest, t)
            if action == "REPORT" and (t, e) > (at, number):
                reports.add((t, e))
            elif action in ("VISIBLE", "HIDDEN") and (t, e) > (at, number):
                at, number, outcome, settled = t, e, action, 0
                reports = {r for r in reports if r > (t, e)}
        old = {r for r in reports if r[0] < watermark}
        settled, reports = settled + len(old), sorted(reports - old)
        state.update((at, number, outcome, settled, [r[0] for r in reports], [r[1] for r in reports], newest))
        state.setTimeoutTimestamp(max(newest // 1000 + horizon_days * DAY_MS, state.getCurrentWatermarkMs() + 1))
        n = settled + len(reports)
        yield pd.DataFrame({"post_id": [key[0]], "status": ["REPORTED" if n else outcome], "open_reports": [n]})

    return fold


def moderation_state(actions: DataFrame, lateness: str = "1 day", horizon_days: int = 90) -> DataFrame:
    """Post status and open reports: a report marks the post, a moderator's decision resolves the open reports.

    Event time decides, not arrival: a decision that comes late resolves the reports before it and leaves those after it.  Events older than
    the watermark are ignored; a post without events for the horizon leaves the state.
    """
    state = "at long, number long, outcome string, settled long, times array<long>, numbers array<long>, newest long"
    out = "post_id long, status string, open_reports long"
    return actions.withWatermark("ts", lateness).groupBy("post_id").applyInPandasWithState(_fold_posts(horizon_days), out, state, "update", "EventTimeTimeout")


def moderation_twin(actions: DataFrame) -> DataFrame:
    """Batch form: last action, and the reports after the last decision (two aggregates, nothing collected)."""
    decided = F.col("action").isin("VISIBLE", "HIDDEN")
    at = F.struct("ts", "event_id")
    last = actions.where(decided | (F.col("action") == "REPORT")).groupBy("post_id").agg(
        F.max_by("action", at).alias("_a"), F.max(F.when(decided, at)).alias("_d")
    )
    reports = actions.where("action = 'REPORT'").join(last.select("post_id", "_d"), "post_id").groupBy("post_id").agg(
        F.count_if(F.col("_d").isNull() | (at > F.col("_d"))).alias("open_reports")
    )
    return last.join(reports, "post_id", "left").select(
        "post_id", F.when(F.col("_a") == "REPORT", "REPORTED").otherwise(F.col("_a")).alias("status"),
        F.coalesce("open_reports", F.lit(0)).cast("bigint").alias("open_reports"),
    )


def _watch(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        _, is_open, deadline = state.get
        state.remove()
        if is_open:
            yield pd.DataFrame({"id": [key[0]], "deadline": [pd.Timestamp(deadline, unit="us")]})
        return
    known = state.get if state.exists else None
    for batch in batches:
        for event in zip(_micros(batch["ts"]), batch["is_open"].tolist(), _micros(batch["deadline"])):
            # of equal times an open event counts, then the later deadline, as in the twin
            if known is None or event > tuple(known):
                known = event
    state.update(tuple(known))
    # an open deadline is over when the watermark has passed it; a closed key stays as long, so that late events do not reopen it
    state.setTimeoutTimestamp(max(known[2] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    yield from ()


def overdue(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """(id, deadline) of keys whose last event left them open and whose deadline the watermark has passed.

    events: (id, ts, is_open, deadline).  Stale jobs: open means waiting in an early
    stage, the deadline is the heartbeat plus 90 minutes.  Payment sessions: open
    means pending, the deadline is the end of the session.
    """
    state = T.StructType().add("seen", T.LongType()).add("is_open", T.BooleanType()).add("deadline", T.LongType())
    return (
        events.withWatermark("ts", lateness).groupBy("id")
        .applyInPandasWithState(_watch, "id long, deadline timestamp", state, "append", "EventTimeTimeout")
    )


def overdue_twin(events: DataFrame, as_of: Column) -> DataFrame:
    last = events.groupBy("id").agg(F.max(F.struct("ts", "is_open", "deadline")).alias("e"))
    return last.where(F.col("e.is_open") & (F.col("e.deadline") < as_of)).select("id", F.col("e.deadline").alias("deadline"))


def heartbeats(jobs: DataFrame, minutes: int = 90) -> DataFrame:
    """Job states as events for overdue()."""
    waiting = (F.col("status") == "PROCESSING") & F.col("stage").isin("QUEUED", "PREPARING")
    return jobs.select("id", F.col("updated_at").alias("ts"), F.coalesce(waiting, F.lit(False)).alias("is_open"), (F.col("updated_at") + F.make_dt_interval(mins=F.lit(minutes))).alias("deadline"))


# ------------------------------------------------------------------------ sinks --
def write_days(metrics: DataFrame, path: str, checkpoint: str):
    """Replace the day folders a micro-batch changed (rerunning a batch gives the same table)."""

    def save(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_date").parquet(path)

    return metrics.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def apply_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run a batch operator (budget, retries, version changes, imports) on each micro-batch.

    The result of a batch lands in its own folder, so a repeated batch replaces itself.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def reserve_stream(requests: DataFrame, sources: DataFrame, path: str, checkpoint: str, **limits):
    """Budget reservation on a stream, with the decisions themselves as the ledger.

    Each micro-batch reads what the batches before it have reserved (usage and content hashes) and writes its decisions to a folder of its
    own.  A batch that is repeated sees the same ledger and replaces itself, so replays and other cuts into batches change nothing.
    """
    spark = requests.sparkSession
    empty = reserve_budget(spark.createDataFrame([], requests.schema), sources, **limits)
    empty.write.mode("ignore").parquet(f"{path}/batch=-1")
    schema = T.StructType([*empty.schema.fields, T.StructField("batch", T.LongType())])

    def save(batch: DataFrame, batch_id: int) -> None:
        ledger = batch.sparkSession.read.schema(schema).parquet(path).where(F.col("batch") < batch_id)
        held = ledger.where(F.col("status").isin("RESERVED", "SETTLED"))
        out = reserve_budget(batch, sources, reserved=held.select("content_hash"), usage=usage_of(held), **limits)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return requests.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
