"""Dates and schedules.  "Now" is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab as V
from .core import col, strip, text


def ts(value) -> Column:
    """A timestamp-without-zone column or literal."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def _date_of(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def parse_cn_date(c) -> Column:
    """First Y年M月D日, else a strict ISO date; null when there is none."""
    raw = text(c)
    cn = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
    parts = [F.regexp_extract(raw, cn, i) for i in (1, 2, 3)]
    iso = F.regexp_extract(raw, r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    return F.when(parts[0] != "", _date_of(*parts)).otherwise(
        F.when(F.rlike(iso, F.lit(r"^\d{4}-\d{2}-\d{2}$")), iso.try_cast("date"))
    )


def parse_published(c) -> Column:
    """Publication time: CN or ISO (zone honoured), RFC 2822, else the first 20YY-M-D [h:mm[:ss]]; as UTC."""
    raw = strip(c)
    norm = F.translate(F.translate(raw, "年月", "--"), "日", "")
    zoned = F.rlike(norm, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"))
    plain = F.rlike(norm, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"))
    # RFC 2822 without the day name; UT/GMT as an offset
    mail = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UT|UTC)$", " +0000")
    pat = r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
    g = [F.regexp_extract(norm, pat, i) for i in range(1, 7)]
    clock = [F.when(x == "", "0").otherwise(x) for x in g[3:]]
    loose = F.when(
        g[0] != "",
        F.concat(
            g[0], F.lit("-"), F.lpad(g[1], 2, "0"), F.lit("-"), F.lpad(g[2], 2, "0"), F.lit(" "),
            F.concat_ws(":", *[F.lpad(x, 2, "0") for x in clock]),
        ).try_cast("timestamp"),
    )
    return F.when(raw != "", F.coalesce(
        F.when(zoned | plain, norm.try_cast("timestamp")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        loose,
    ))


def candidate_date(c) -> Column:
    """Date of an offset date-time, else of the first ten characters, else null."""
    raw = strip(c)
    iso = r"^\d{4}-\d{2}-\d{2}"
    return F.when(F.rlike(raw, F.lit(iso)), F.substring(raw, 1, 10).try_cast("date"))


def next_retry(retry_count, as_of) -> Column:
    minutes = F.least(F.lit(60), F.pow(F.lit(2.0), F.least(col(retry_count), F.lit(6))).cast("int"))
    return ts(as_of) + F.make_dt_interval(mins=minutes)


def next_run(schedule_mode, interval_hours, daily_time, zone, as_of_utc, zones: list[str] | None = None) -> Column:
    """Next run in local time of the zone.

    INTERVAL adds hours; DAILY takes the next occurrence of HH:mm.  An unknown
    zone or a bad time falls back to the defaults.
    """
    tz = col(zone) if zones is None else F.when(col(zone).isin(zones), col(zone)).otherwise(F.lit(V.DEFAULT_ZONE))
    local = F.convert_timezone(F.lit("UTC"), tz, ts(as_of_utc))
    by_hours = local + F.make_dt_interval(hours=F.coalesce(col(interval_hours), F.lit(24)))
    hhmm = strip(daily_time)
    hhmm = F.when(F.rlike(hhmm, F.lit(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")), hhmm).otherwise(F.lit(V.DEFAULT_CRAWL_TIME))
    at = F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(" "), F.substring(hhmm, 1, 5), F.lit(":00")).cast("timestamp_ntz")
    daily = F.when(at > local, at).otherwise(at + F.make_dt_interval(days=F.lit(1)))
    return F.when(F.upper(text(schedule_mode)) == "INTERVAL", by_hours).otherwise(daily)


def local_day(utc_ts, zone: str = V.DEFAULT_ZONE) -> Column:
    """Budget day: the calendar day in the zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(utc_ts)).cast("date")


def next_local_midnight(utc_ts, zone: str = V.DEFAULT_ZONE) -> Column:
    """When a blocked request may be looked at again (UTC)."""
    start = F.date_add(local_day(utc_ts, zone), 1).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), start)
