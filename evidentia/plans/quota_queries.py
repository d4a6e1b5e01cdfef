"""Admission over the events table: user as session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quota
from ..streaming import admission
from .base import big, query, table

FOLD = """RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, ts, i, true AS ok, '' AS reason, 1 AS used, ts AS last FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.ts, e.i, f.used < 8 AND NOT (e.ts - f.last < INTERVAL 3600 SECOND), CASE WHEN f.used >= 8 THEN 'session' WHEN e.ts - f.last < INTERVAL 3600 SECOND THEN 'gap' ELSE '' END,
  f.used + CASE WHEN f.used < 8 AND NOT (e.ts - f.last < INTERVAL 3600 SECOND) THEN 1 ELSE 0 END, CASE WHEN f.used < 8 AND NOT (e.ts - f.last < INTERVAL 3600 SECOND) THEN e.ts ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)"""


# All three limits: one order over all requests, the state carried from one to the next.
ALL_LIMITS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS session, CAST(NULL AS BIGINT) AS event_id, '' AS reason, CAST(-1 AS BIGINT) AS day, CAST(0 AS BIGINT) AS used, CAST(MAP {} AS MAP(BIGINT, STRUCT(c BIGINT, t DOUBLE))) AS seen
 UNION ALL SELECT i, user_id, event_id, reason, day, used + CASE WHEN reason = '' THEN 1 ELSE 0 END, CASE WHEN reason = '' THEN map_concat(seen, map([user_id], [struct_pack(c := coalesce(s.c, 0) + 1, t := sec)])) ELSE seen END
  FROM (SELECT *, CASE WHEN s.c >= 50 THEN 'session' WHEN used >= 25 THEN 'daily' WHEN 60 - (sec - s.t) > 0 THEN 'gap' ELSE '' END AS reason
   FROM (SELECT e.*, f.seen, f.seen[e.user_id] AS s, CAST(floor(sec / 86400) AS BIGINT) AS day, CASE WHEN f.day = floor(sec / 86400) THEN f.used ELSE 0 END AS used FROM f JOIN e ON e.i = f.i + 1)))
SELECT session, event_id, reason = '' AS ok, reason, greatest(25 - used, 0) AS remaining_today FROM f WHERE i > 0"""


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("session"), "event_id", "ts")


def _admitted(spark, d):
    return quota.admit_by_session(_events(spark, d), gap=3600.0)


@query(f"WITH {FOLD} SELECT user_id AS session, event_id, ok, reason, CAST(used AS BIGINT) AS used FROM f")
def quota_gap_cap(spark, d):
    return big(_admitted(spark, d).select("session", "event_id", "ok", "reason", "used"), "used")


@query(f"WITH {FOLD} SELECT CAST(ts AS DATE) AS day, count(*) AS used FROM f WHERE ok GROUP BY 1")
def quota_daily_used(spark, d):
    return quota.used_by_day(_admitted(spark, d).where("ok"))


@query(f"WITH {FOLD} SELECT CAST(ts AS DATE) AS day, greatest(25 - count(*), 0) AS remaining FROM f WHERE ok GROUP BY 1")
def quota_remaining(spark, d):
    return quota.used_by_day(_admitted(spark, d).where("ok")).select("day", quota.remaining(F.col("used")).alias("remaining"))


@query("SELECT event_id, CAST(86400 - (epoch(date_trunc('second', ts)) - epoch(date_trunc('day', ts))) AS BIGINT) AS seconds FROM events")
def seconds_to_midnight(spark, d):
    return table(spark, d, "events").select("event_id", X.seconds_to_midnight(F.col("ts")).cast("bigint").alias("seconds"))


@query("SELECT event_id, CASE WHEN m >= 60 THEN (m // 60) || 'h ' || (m % 60) || 'm' WHEN m > 0 THEN m || 'm' ELSE s || 's' END AS wait FROM (SELECT event_id, s, s // 60 AS m FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events))")
def wait_format(spark, d):
    return table(spark, d, "events").select("event_id", X.format_wait(F.col("event_id") * 7 % 9000).alias("wait"))


@query("""WITH e AS (SELECT event_id, event_id % 11 AS su, CASE WHEN event_id % 3 > 0 THEN event_id % 7 END AS since, event_id % 30 AS used FROM events),
r AS (SELECT *, CASE WHEN su >= 8 THEN 'session' WHEN used >= 25 THEN 'daily' WHEN 4 - since > 0 THEN 'gap' ELSE '' END AS reason FROM e)
SELECT event_id, reason = '' AS ok, reason, greatest(25 - used, 0) AS remaining_today, CASE WHEN reason = 'gap' THEN CAST(4 - since AS DOUBLE) ELSE 0 END AS wait_seconds FROM r""")
def quota_check(spark, d):
    i = F.col("event_id")
    now = F.lit(1_704_067_200.0) + i
    last = F.when(i % 3 > 0, now - i % 7)
    c = quota.check(i % 11, last, now, i % 30)
    return big(table(spark, d, "events").select("event_id", c.alias("c")).select("event_id", "c.ok", "c.reason", "c.remaining_today", "c.wait_seconds"), "remaining_today")


@query(ALL_LIMITS)
def quota_all_limits(spark, d):
    return quota.admit(_events(spark, d), per_session=50, per_day=25, gap=60.0).select("session", "event_id", "ok", "reason", "remaining_today")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY 1")
def streaming_daily_count(spark, d):
    return admission.daily_counts(spark, f"{d}/events.parquet")


@query(f"WITH {FOLD} SELECT user_id AS session, event_id, ok, reason, CAST(used AS BIGINT) AS used FROM f")
def streaming_session_quota(spark, d):
    return big(admission.admit_sessions_once(spark, f"{d}/events.parquet", gap=3600.0), "used")


@query(ALL_LIMITS)
def streaming_quota(spark, d):
    return admission.admit_stream_once(spark, f"{d}/events.parquet", per_session=50, per_day=25, gap=60.0)
