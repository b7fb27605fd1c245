"""Ordered admission against a plain loop; reasons; queue; retries; sessions."""
import datetime as dt
import random

from pyspark.sql import functions as F

from noticeboard.operators import budget as B
from noticeboard.operators.joins import accept_in_order

T0 = dt.datetime(2026, 7, 1, 10)
REQ = "queue_id long, source_id long, task_root_id long, text string, content_hash string, approved boolean, created_at timestamp_ntz"
SRC = "source_id long, daily_article_budget int, daily_token_budget int, allow_auto_ai boolean"


def loop(requests, sources, ga, gt, max_chars, per_task):
    """The published rules, one request after the other."""
    used, hashes, tasks, out = {}, set(), {}, {}
    for q, s, task, text, h, ok, at in sorted(requests, key=lambda r: (r[6], r[0])):
        est = 0 if not text.strip() else max(1, -(-len(text) // 2))
        src = sources.get(s)

        def full(key, rows, tokens):
            n, t = used.get(key, (0, 0))
            return "BUDGET_ARTICLES" if rows and n >= rows else "BUDGET_TOKENS" if tokens and t + est > tokens else None

        why = "INPUT_TOO_LONG" if len(text) > max_chars else "CONTENT_HASH_DUPLICATE" if h in hashes else None
        if not why and per_task and task is not None and tasks.get(task, 0) >= per_task:
            why = "TASK_ARTICLE_LIMIT"
        why = why or full((at.date(),), ga, gt)
        if not why and src:
            why = "SOURCE_APPROVAL_REQUIRED" if not ok and not src[2] else full((at.date(), s), src[0], src[1])
        out[q] = why
        if why is None:
            hashes.add(h)
            tasks[task] = tasks.get(task, 0) + 1
            for key in ((at.date(),), (at.date(), s)):
                n, t = used.get(key, (0, 0))
                used[key] = (n + 1, t + est)
    return out


def test_matches_a_plain_loop(spark):
    rnd = random.Random(5)
    sources = {1: (3, 0, True), 2: (0, 60, True), 3: (0, 0, False)}
    rows = [
        (i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, 7, 8, 9]), "x" * rnd.choice([2, 10, 30, 64, 300]), f"h{rnd.randrange(40)}", rnd.random() < 0.3,
         T0 + dt.timedelta(hours=rnd.randrange(60), minutes=i))
        for i in range(60)
    ]
    for limits in ((5, 0, 200, 4), (0, 150, 200, 0)):
        out = B.reserve_budget(spark.createDataFrame(rows, REQ), spark.createDataFrame([(k, *v) for k, v in sources.items()], SRC), *limits)
        assert {r.queue_id: r.reason_code for r in out.collect()} == loop(rows, sources, *limits), limits


def test_tight_limits_in_many_blocks(spark):
    """Limits that flip between rows, over one block and over several."""
    rnd = random.Random(9)
    sources = {k: (0, rnd.choice([70, 90, 400]), True) for k in range(4)}
    rows = [(i, rnd.randrange(5), rnd.choice([None, 7, 8]), "x" * rnd.randrange(1, 120), f"h{rnd.randrange(150)}", True, T0 + dt.timedelta(hours=rnd.randrange(30), minutes=i)) for i in range(200)]
    limits = (0, 700, 110, 40)
    want = loop(rows, sources, *limits)
    src = spark.createDataFrame([(k, *v) for k, v in sources.items()], SRC)
    assert {r.queue_id: r.reason_code for r in B.reserve_budget(spark.createDataFrame(rows, REQ), src, *limits).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = B.reserve_budget(spark.createDataFrame(rows, REQ), src, *limits).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.queue_id: r.reason_code for r in out} == want


def test_chain_of_alternating_keys(spark):
    """Row i shares one key with row i - 1 and the other with row i + 1: every other row is accepted."""
    df = spark.range(10_000).select(F.col("id").alias("n"), F.floor(F.col("id") / 2).alias("a"), F.floor((F.col("id") + 1) / 2).alias("b"))
    got = accept_in_order(df, ["a", "b"], ["n"]).where("accepted").agg(F.count("*"), F.max(F.col("n") % 2)).first()
    assert tuple(got) == (5_000, 0)


def test_batches_carry_usage_and_exempt_rows_are_free(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([1, 2, None]), rnd.choice([None, 7]), "x" * rnd.choice([4, 40]), f"h{rnd.randrange(25)}", True, T0 + dt.timedelta(minutes=i)) for i in range(30)]
    sources = spark.createDataFrame([(1, 4, 0, True), (2, 0, 90, True)], SRC)
    limits = {"global_articles": 12, "global_tokens": 200, "max_chars": 100, "per_task": 6}
    whole = {r.queue_id: r.reason_code for r in B.reserve_budget(spark.createDataFrame(rows, REQ), sources, **limits).collect()}
    first = B.reserve_budget(spark.createDataFrame(rows[:15], REQ), sources, **limits)
    held = first.where("status = 'RESERVED'").select("content_hash")
    second = B.reserve_budget(spark.createDataFrame(rows[15:], REQ), sources, **limits, reserved=held, usage=B.usage_of(first))
    assert {r.queue_id: r.reason_code for r in first.union(second).collect()} == whole
    free = spark.createDataFrame(rows, REQ).withColumn("exempt", F.col("queue_id") % 2 == 0)
    out = B.reserve_budget(free, sources, **limits).collect()
    assert {r.reason_code for r in out if r.exempt} <= {None, "CONTENT_HASH_DUPLICATE"}
    assert sum(r.status == "RESERVED" and not r.exempt for r in out) <= 12 and sum(r.status == "RESERVED" for r in out) > sum(v is None for v in whole.values())


def test_next_local_day_resets(spark):
    rows = [(i, None, None, "ab", f"h{i}", True, T0 + dt.timedelta(hours=h)) for i, h in enumerate((0, 1, 7))]  # 18:00, 19:00 and 01:00 local time
    out = B.reserve_budget(spark.createDataFrame(rows, REQ), spark.createDataFrame([], SRC), global_articles=1, zone="Asia/Shanghai").orderBy("queue_id").collect()
    assert [r.reason_code for r in out] == [None, "BUDGET_ARTICLES", None] and out[1].available_at == dt.datetime(2026, 7, 1, 16)


def test_queue_and_settle(spark):
    req = spark.createDataFrame([(1, "a", T0), (2, "a", T0), (3, "b", T0)], "queue_id long, content_hash string, created_at timestamp_ntz")
    old = spark.createDataFrame([(0, "b")], "queue_id long, content_hash string")
    assert {r.queue_id: (r.status, r.existing_id) for r in B.admit_queue(req, old, False, T0).collect()} == {1: ("WAITING_APPROVAL", None), 2: ("DUPLICATE", 1), 3: ("DUPLICATE", 0)}
    q = spark.createDataFrame([(1, 1, "FAILED", None), (2, 2, "WAITING_APPROVAL", None), (3, 2, "WAITING_BUDGET", T0), (4, 1, "SUCCEEDED", T0)], "queue_id long, source_id long, status string, approved_at timestamp_ntz")
    src = spark.createDataFrame([(1, True, True), (2, True, False)], "source_id long, enabled boolean, allow_auto_ai boolean")
    assert [r.requeued for r in B.reconcile(q, src, True).orderBy("queue_id").collect()] == [True, False, True, False]
    res = spark.createDataFrame([(1, "RESERVED"), (2, "RESERVED"), (3, "RESERVED")], "queue_id long, status string")
    got = B.settle(res, spark.createDataFrame([(1, True, 5), (2, False, -3)], "queue_id long, success boolean, actual_tokens long"))
    assert {r.queue_id: (r.status, r.actual_tokens) for r in got.collect()} == {1: ("SETTLED", 5), 2: ("FAILED", 0), 3: ("RESERVED", 0)}


def test_retries(spark):
    e = spark.createDataFrame([(1, 1, "u1", True, 0, None), (2, 1, "u2", True, 2, None), (3, 2, "u3", True, 2, None), (4, 1, "u4", False, 0, None), (5, 1, "u5", True, 0, T0), (6, 1, "u6", True, 0, None)],
                              "id long, source_registry_id long, failed_url string, retryable boolean, retry_count int, resolved_at timestamp_ntz")
    jobs = spark.createDataFrame([(1, "u6", "SUCCESS"), (2, "u1", "SUCCESS")], "source_registry_id long, canonical_url string, status string")
    src = spark.createDataFrame([(1, 2), (2, 0)], "source_registry_id long, max_retries int")
    out = B.schedule_retries(e, jobs, src, T0, 3).orderBy("error_id").collect()
    assert [(r.error_id, r.retry_count, r.discovered_at) for r in out] == [(1, 1, T0 + dt.timedelta(minutes=2)), (3, 3, T0 + dt.timedelta(minutes=8))]


def test_sessions(spark):
    s = spark.createDataFrame([(i, 1, "PENDING", T0) for i in range(3)] + [(3, 1, "CANCELLED", T0)], "session_id long, plan_id long, status string, expires_at timestamp_ntz")
    c = spark.createDataFrame([(0, T0 - dt.timedelta(minutes=1)), (1, T0 + dt.timedelta(minutes=1))], "session_id long, confirmed_at timestamp_ntz")
    p = spark.createDataFrame([(1, 30)], "plan_id long, duration_days int")
    out = {r.session_id: (r.status, r.membership_expires_at) for r in B.expire_sessions(s, c, p, T0 + dt.timedelta(hours=1)).collect()}
    assert out == {0: ("SUCCESS", T0 - dt.timedelta(minutes=1) + dt.timedelta(days=30)), 1: ("EXPIRED", None), 2: ("EXPIRED", None), 3: ("CANCELLED", None)}


def test_blocks_have_bounded_rows(spark, monkeypatch):
    """A range partition of any size is decided in blocks of bounded rows, with the decisions of a plain loop."""
    decide = B._decide_block

    def bounded(names, fields):
        run, most = decide(names, fields), 16

        def held(rows, opening):
            if rows.num_rows > most:
                raise ValueError("too many rows in one block")
            return run(rows, opening)

        return held

    monkeypatch.setattr(B, "BLOCK_ROWS", 16, raising=False)
    monkeypatch.setattr(B, "_decide_block", bounded)
    rows = [(i, f"u{i * 7 % 90}", f"h{i * i % 110}" if i % 9 else None) for i in range(400)]
    got = accept_in_order(spark.createDataFrame(rows, "id int, u string, h string").coalesce(1), ["u", "h"], ["id"])
    seen, want = set(), set()
    for i, u, h in rows:
        if not {("u", u), ("h", h)} & seen:
            want.add(i)
            seen |= {("u", u)} | ({("h", h)} if h else set())
    assert {r.id for r in got.where("accepted").collect()} == want and got.count() == 400
