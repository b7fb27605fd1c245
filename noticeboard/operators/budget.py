"""Processing queue: admission, budget reservation in order, retries and session expiry."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.core import nulls_to
from ..functions.dates import local_day, next_local_midnight, next_retry, ts
from ..functions.texts import estimate_tokens
from .ordered import Rounds, in_blocks

BLOCK_ROWS = 20_000  # a block is one task's group, whose rows become Python objects


@dataclass(frozen=True)
class Capacity:
    """A shared limit: rows with the same keys use it up together, in order.

    rows and amount are limit columns (null or 0 means unlimited), used_rows and
    used_amount what earlier runs have used up, applies the rows that the limit
    binds and counts those that use it up (all rows, where not given).
    """

    name: str
    keys: tuple[str, ...]
    rows: Column | None = None
    amount: Column | None = None
    used_rows: Column | None = None
    used_amount: Column | None = None
    applies: Column | None = None
    counts: Column | None = None


def _limit(c: Column | None, used: Column | None = None) -> Column:
    """What is left of a limit; null is unlimited."""
    if c is None:
        return F.lit(None).cast("bigint")
    return F.when(c > 0, c.cast("bigint") - (F.lit(0) if used is None else nulls_to(used, 0)))


def _key(keys: tuple[str, ...]) -> Column:
    """Text that names a combination of key values."""
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))


def _decide_block(names: list[str], fields: list[str]):
    """One block of rows in order, given bounds on what earlier blocks use up: decides every row that the bounds decide."""

    def run(rows: pa.Table, opening: pa.Table) -> pa.Table:
        used = {(r["cap"], r["key"]): [r["lo_n"], r["lo_s"], r["hi_n"], r["hi_s"]] for r in opening.to_pylist()}
        out = sorted(rows.select([c for c in fields if c in rows.column_names]).to_pylist(), key=lambda r: r["_i"])
        exact = True
        for r in out:
            fits, never, amount = True, False, r["_amount"] or 0
            mine = [(n, used.setdefault((n, r[f"_key_{n}"]), [0, 0, 0, 0])) for n in names]
            for n, u in mine:
                rows_left, most = r[f"_rows_{n}"], r[f"_most_{n}"]
                for wide in (False, True):
                    count, total = u[2 * wide], u[2 * wide + 1]
                    room = (rows_left is None or count < rows_left) and (most is None or total + amount <= most)
                    fits, never = (fits and room, never) if wide else (fits, never or not room)
                r[f"{n}_n"], r[f"{n}_s"] = u[0], u[1]
                exact = exact and u[0] == u[2] and u[1] == u[3]
            if r["_state"] == "?" and (fits or never):
                r["_state"] = "yes" if fits else "no"
            exact = exact and r["_state"] != "?"
            for n, u in mine:
                if r["_state"] != "no" and r[f"_counts_{n}"]:
                    sure = r["_state"] == "yes"
                    u[:] = [u[0] + sure, u[1] + amount * sure, u[2] + 1, u[3] + amount]
        for r in out:
            r["_exact"] = exact
        schema = pa.schema([rows.schema.field(c) if c in rows.column_names else pa.field(c, pa.bool_() if c == "_exact" else pa.int64()) for c in fields])
        return pa.Table.from_pylist(out, schema)

    return run


def _uses(rows: DataFrame, capacities: list[Capacity]) -> DataFrame:
    """(_block, cap, key, lo_n, lo_s, hi_n, hi_s): what the rows of a block use up, at least and at most."""
    def one(c):
        sure = F.col(f"_counts_{c.name}") & (F.col("_state") == "yes")
        maybe = F.col(f"_counts_{c.name}") & (F.col("_state") != "no")
        size = nulls_to(F.col("_amount"), 0)
        return F.struct(
            F.lit(c.name).alias("cap"), F.col(f"_key_{c.name}").alias("key"), sure.cast("bigint").alias("lo_n"), F.when(sure, size).otherwise(0).alias("lo_s"),
            maybe.cast("bigint").alias("hi_n"), F.when(maybe, size).otherwise(0).alias("hi_s"),
        )

    each = rows.select("_block", F.explode(F.array(*[one(c) for c in capacities])).alias("u")).select("_block", "u.*")
    return each.groupBy("_block", "cap", "key").agg(*[F.sum(n).alias(n) for n in ("lo_n", "lo_s", "hi_n", "hi_s")])


def admit_in_order(df: DataFrame, capacities: list[Capacity], order: list[str], amount: Column, eligible: Column) -> DataFrame:
    """First come, first served admission under several shared limits at once.

    A row is admitted when it is eligible and, for every capacity, the *admitted*
    rows before it leave room: fewer rows than the row limit, and their amount plus
    its own within the amount limit.  Adds admitted and, per capacity, used_rows and
    used_amount (<name>_n, <name>_s) as the row saw them.  order must be unique.

    Rows are range-partitioned by the order into blocks.  Each round tells every block
    what the blocks before it use up of each of its keys, at least (admitted) and at
    most (admitted or undecided): one sum per (block, key) and a running total over
    blocks.  A block then goes through its rows once, with the bounds moving along, and
    decides what they decide.  The first open block always has equal bounds, so it is
    finished in every round, and a limit that is used up, or far from it, decides all
    blocks at once: rounds follow blocks, not rows, and no task holds more than a block, of at most BLOCK_ROWS rows.
    """
    keys = list(dict.fromkeys(k for c in capacities for k in c.keys))
    slim = df.select(*dict.fromkeys([*order, *keys]), amount.cast("bigint").alias("_amount"), nulls_to(eligible, False).alias("_ok"), *[
        v.alias(n) for c in capacities for n, v in _bounds(c).items()
    ])
    slim = slim.select(*order, "_amount", F.when(F.col("_ok"), "?").otherwise("no").alias("_state"), *[n for c in capacities for n in _bounds(c)], *[_key(c.keys).alias(f"_key_{c.name}") for c in capacities])
    blocks = in_blocks(slim, {"_block": []}, [F.col(c) for c in order])
    open_ = blocks.withColumn("_i", F.row_number().over(Window.partitionBy("_block").orderBy(*order)).cast("bigint"))
    # a range partition grows with the input, a block does not
    open_ = open_.withColumn("_block", F.shiftleft(F.col("_block").cast("bigint"), 32) + F.floor((F.col("_i") - 1) / BLOCK_ROWS))
    names = [c.name for c in capacities]
    seen = [f"{n}_{m}" for n in names for m in ("n", "s")]
    fields = [*open_.columns, *seen, "_exact"]
    schema = StructType([*open_.schema.fields, *[StructField(n, LongType()) for n in seen], StructField("_exact", BooleanType())])
    before = Window.partitionBy("cap", "key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rounds, finished, settled = Rounds(df.sparkSession), None, None
    while True:
        uses = _uses(open_, capacities)
        line = uses if settled is None else uses.unionByName(settled)
        opening = line.select("_block", "cap", "key", *[nulls_to(F.sum(n).over(before), 0).alias(n) for n in ("lo_n", "lo_s", "hi_n", "hi_s")])
        if settled is not None:
            opening = opening.join(open_.select("_block").distinct(), "_block", "left_semi")
        opening = opening.withColumnRenamed("_block", "_to")
        step = rounds.put(open_.groupBy("_block").cogroup(opening.groupBy("_to")).applyInArrow(_decide_block(names, fields), schema))
        done = step.where("_exact")
        finished = done if finished is None else finished.unionByName(done)
        open_ = step.where("NOT _exact").drop(*seen, "_exact")
        if open_.isEmpty():
            break
        sums = rounds.put(_uses(done, capacities))
        settled = sums if settled is None else settled.unionByName(sums)
    final = rounds.close(finished.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], (F.col("_state") == "yes").alias("admitted"), *seen))
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & df[c].eqNullSafe(final[f"_o{i}"])
    return df.join(final, same).drop(*[f"_o{i}" for i in range(len(order))])


def _bounds(c: Capacity) -> dict[str, Column]:
    """What is left of the limits of a capacity for a row, and whether the row uses it up."""
    applies = F.lit(True) if c.applies is None else c.applies
    return {
        f"_rows_{c.name}": F.when(applies, _limit(c.rows, c.used_rows)), f"_most_{c.name}": F.when(applies, _limit(c.amount, c.used_amount)),
        f"_counts_{c.name}": F.lit(True) if c.counts is None else nulls_to(c.counts, False),
    }


def reserve_budget(
    requests: DataFrame, sources: DataFrame, global_articles: int = 0, global_tokens: int = 0, max_chars: int = 12000, per_task: int = 0,
    zone: str | None = None, reserved: DataFrame | None = None, usage: DataFrame | None = None,
) -> DataFrame:
    """Ordered decisions on processing requests, each with the reason and the time it may be looked at again.

    requests (queue_id, source_id, task_root_id, text, content_hash, approved, created_at);
    sources (source_id, daily_article_budget, daily_token_budget, allow_auto_ai); a limit of
    0 is unlimited.  reserved names content hashes that are reserved or settled already, usage what
    earlier runs have used up (see usage_of).  Requests with a true column exempt, if there
    is one, are bound by length and duplicates only and use up no daily limit.
    Reasons are tested in a fixed order: too long, duplicate text, task limit, global
    articles, global tokens, missing approval, source articles, source tokens.
    """
    day = local_day("created_at", zone) if zone else F.col("created_at").cast("date")
    limits = sources.select("source_id", "daily_article_budget", "daily_token_budget", "allow_auto_ai")
    r = requests.join(limits, "source_id", "left").withColumns({
        "budget_date": day, "estimated_tokens": estimate_tokens("text").cast("bigint"), "_long": F.length("text") > max_chars,
        "_unapproved": F.col("source_id").isNotNull() & ~nulls_to(F.col("approved"), False) & ~nulls_to(F.col("allow_auto_ai"), False),
    })
    if reserved is not None:
        seen = reserved.select("content_hash").distinct().withColumn("_seen", F.lit(True))
        r = r.join(seen, "content_hash", "left").withColumn("_seen", nulls_to(F.col("_seen"), False))
    else:
        r = r.withColumn("_seen", F.lit(False))
    free = nulls_to(F.col("exempt"), False) if "exempt" in requests.columns else F.lit(False)
    r = r.withColumns({"_free": free, "_unapproved": F.col("_unapproved") & ~free})
    opening = {"TASK": ["task_root_id"], "GLOBAL": ["budget_date"], "SOURCE": ["budget_date", "source_id"]}
    for scope, on in opening.items():
        n, s = f"_{scope}_n", f"_{scope}_s"
        if usage is None:
            r = r.withColumns({n: F.lit(0).cast("bigint"), s: F.lit(0).cast("bigint")})
        else:
            r = r.join(usage.where(F.col("scope") == scope).select(*on, F.col("n").alias(n), F.col("amount").alias(s)), on, "left").na.fill(0, [n, s])
    used = lambda scope: {"used_rows": F.col(f"_{scope}_n"), "used_amount": F.col(f"_{scope}_s")}
    bound, automatic = {"applies": ~F.col("_free")}, {"applies": ~F.col("_free"), "counts": ~F.col("_free")}
    caps = [Capacity("copy", ("content_hash",), rows=F.lit(1))]
    if per_task > 0:
        caps.append(Capacity("task", ("task_root_id",), rows=F.when(F.col("task_root_id").isNotNull(), F.lit(per_task)), **used("TASK"), **bound))
    if global_articles > 0 or global_tokens > 0:
        caps.append(Capacity("all", ("budget_date",), rows=F.lit(global_articles), amount=F.lit(global_tokens), **used("GLOBAL"), **automatic))
    caps.append(Capacity("source", ("budget_date", "source_id"), rows=F.col("daily_article_budget"), amount=F.col("daily_token_budget"), **used("SOURCE"), **automatic))
    out = admit_in_order(r, caps, ["created_at", "queue_id"], F.col("estimated_tokens"), ~F.col("_long") & ~F.col("_seen") & ~F.col("_unapproved"))

    def exhausted(name, scope, rows, amount):
        n, s = F.col(f"{name}_n") + F.col(f"_{scope}_n"), F.col(f"{name}_s") + F.col(f"_{scope}_s")
        full = F.when(F.col("_free"), None).when((rows > 0) & (n >= rows), "BUDGET_ARTICLES")
        return full.when((amount > 0) & (s + F.col("estimated_tokens") > amount), "BUDGET_TOKENS")

    names = {c.name for c in caps}
    none = F.lit(None).cast("string")
    reason = F.coalesce(
        F.when(F.col("_long"), "INPUT_TOO_LONG"), F.when(F.col("_seen") | (F.col("copy_n") > 0), "CONTENT_HASH_DUPLICATE"),
        F.when(~F.col("_free") & F.col("task_root_id").isNotNull() & (F.col("task_n") + F.col("_TASK_n") >= per_task), "TASK_ARTICLE_LIMIT") if "task" in names else none,
        exhausted("all", "GLOBAL", F.lit(global_articles), F.lit(global_tokens)) if "all" in names else none,
        F.when(F.col("_unapproved"), "SOURCE_APPROVAL_REQUIRED"),
        F.when(F.col("source_id").isNotNull(), exhausted("source", "SOURCE", F.col("daily_article_budget"), F.col("daily_token_budget"))),
    )
    status = (
        F.when(F.col("admitted"), "RESERVED").when(F.col("reason_code") == "SOURCE_APPROVAL_REQUIRED", "WAITING_APPROVAL")
        .when(F.col("reason_code") == "CONTENT_HASH_DUPLICATE", "DUPLICATE").otherwise("WAITING_BUDGET")
    )
    midnight = next_local_midnight("created_at", zone) if zone else F.date_add("budget_date", 1).cast("timestamp_ntz")
    return out.withColumn("reason_code", F.when(~F.col("admitted"), reason)).withColumn("status", status).select(
        *requests.columns, "budget_date", "estimated_tokens", "status", "reason_code",
        F.when(F.col("status") == "WAITING_BUDGET", midnight).alias("available_at"),
    )


def usage_of(decisions: DataFrame) -> DataFrame:
    """usage(scope, budget_date, source_id, task_root_id, n, amount) of rows that are reserved or settled, for the next run."""
    held = decisions.where(F.col("status").isin("RESERVED", "SETTLED"))
    bound = held.where(~nulls_to(F.col("exempt"), False)) if "exempt" in decisions.columns else held
    sums = [F.count(F.lit(1)).alias("n"), F.sum("estimated_tokens").alias("amount")]
    no = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    date, source, task = ("budget_date", "date"), ("source_id", "bigint"), ("task_root_id", "bigint")
    parts = [
        held.where("task_root_id IS NOT NULL").groupBy("task_root_id").agg(*sums).select(F.lit("TASK").alias("scope"), *no(date, source), "task_root_id", "n", "amount"),
        bound.groupBy("budget_date").agg(*sums).select(F.lit("GLOBAL").alias("scope"), "budget_date", *no(source, task), "n", "amount"),
        bound.where("source_id IS NOT NULL").groupBy("budget_date", "source_id").agg(*sums).select(F.lit("SOURCE").alias("scope"), "budget_date", "source_id", *no(task), "n", "amount"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def settle(reservations: DataFrame, results: DataFrame) -> DataFrame:
    """Reserved rows with a result become SETTLED or FAILED with their actual tokens; other rows stay."""
    r = results.select("queue_id", F.col("success").alias("_ok"), F.greatest(F.lit(0).cast("bigint"), F.col("actual_tokens").cast("bigint")).alias("_actual"))
    open_ = (F.col("status") == "RESERVED") & F.col("_ok").isNotNull()
    return reservations.join(r, "queue_id", "left").withColumns({
        "actual_tokens": F.when(open_, F.col("_actual")).otherwise(F.lit(0).cast("bigint")),
        "status": F.when(open_, F.when(F.col("_ok"), "SETTLED").otherwise("FAILED")).otherwise(F.col("status")),
    }).drop("_ok", "_actual")


def admit_queue(requests: DataFrame, existing: DataFrame, auto: bool, as_of) -> DataFrame:
    """One queue row per text: known texts keep their row, the first request of a new text is queued or waits.

    Adds existing_id (the row that stands for a duplicate), status and available_at.
    """
    known = existing.groupBy("content_hash").agg(F.min("queue_id").alias("_known"))
    first = requests.groupBy("content_hash").agg(F.min(F.struct("created_at", "queue_id")).alias("_f"))
    out = requests.join(known, "content_hash", "left").join(first, "content_hash")
    owner = F.coalesce("_known", "_f.queue_id")
    duplicate = owner != F.col("queue_id")
    status = F.when(duplicate, "DUPLICATE").otherwise("QUEUED" if auto else "WAITING_APPROVAL")
    return out.withColumns({
        "existing_id": F.when(duplicate, owner), "status": status,
        "available_at": F.when(status == "QUEUED", ts(as_of)), "reason_code": F.when(status == "WAITING_APPROVAL", "AUTO_AI_DISABLED"),
    }).drop("_known", "_f")


def reconcile(queue: DataFrame, sources: DataFrame, auto: bool) -> DataFrame:
    """Waiting or failed rows go back to QUEUED when approved, or when automation and their source allow it."""
    allowed = sources.where("enabled and allow_auto_ai").select(F.col("source_id"), F.lit(True).alias("_may"))
    waiting = F.col("status").isin("WAITING_APPROVAL", "WAITING_BUDGET", "FAILED")
    may = F.col("approved_at").isNotNull() | (F.lit(auto) & nulls_to(F.col("_may"), False))
    return queue.join(allowed, "source_id", "left").withColumn("requeued", waiting & may).withColumn(
        "status", F.when(F.col("requeued"), "QUEUED").otherwise(F.col("status"))
    ).drop("_may")


def schedule_retries(errors: DataFrame, jobs: DataFrame, sources: DataFrame, as_of, default_max: int = 3) -> DataFrame:
    """Child jobs of retryable errors: unresolved, below the source's (else the default) maximum, address not yet successful."""
    limit = F.when(F.col("max_retries") > 0, F.col("max_retries")).otherwise(F.lit(max(1, default_max)))
    done = jobs.where("status = 'SUCCESS'").select("source_registry_id", F.col("canonical_url").alias("failed_url"))
    due = (
        errors.where(nulls_to(F.col("retryable"), False) & F.col("resolved_at").isNull())
        .join(sources.select("source_registry_id", "max_retries"), "source_registry_id")
        .where(F.col("retry_count") < limit).join(done, ["source_registry_id", "failed_url"], "left_anti")
    )
    n = F.col("retry_count") + 1
    return due.select(
        F.col("id").alias("error_id"), "source_registry_id", F.col("failed_url").alias("canonical_url"), F.lit("PENDING").alias("status"),
        F.lit("RETRY").alias("trigger_type"), n.alias("retry_count"), next_retry(n, as_of).alias("discovered_at"),
    )


def expire_sessions(sessions: DataFrame, confirmations: DataFrame, plans: DataFrame, as_of) -> DataFrame:
    """Payment sessions at a point in time: SUCCESS (with the membership end) when confirmed in time, EXPIRED when overdue.

    A session counts as overdue when its end lies before the moment looked at.
    """
    first = confirmations.groupBy("session_id").agg(F.min("confirmed_at").alias("_at"))
    out = sessions.join(first, "session_id", "left").join(plans.select("plan_id", "duration_days"), "plan_id", "left")
    pending = F.col("status") == "PENDING"
    paid = pending & nulls_to((F.col("_at") <= F.col("expires_at")) & (F.col("_at") <= ts(as_of)), False)
    late = pending & ~paid & nulls_to(F.col("expires_at") < ts(as_of), False)
    return out.withColumns({
        "status": F.when(paid, "SUCCESS").when(late, "EXPIRED").otherwise(F.col("status")),
        "membership_expires_at": F.when(paid, F.col("_at") + F.make_dt_interval(days=F.col("duration_days").cast("int"))),
    }).drop("_at", "duration_days")
