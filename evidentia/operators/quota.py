"""Admission of requests: a cap per session, a cap per day, a least gap after the last admitted one. Refusals consume nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .index import written

#: Fixed values.
PER_SESSION, PER_DAY, GAP_SECONDS = 8, 25, 4.0
DECISION = "ok boolean, reason string, remaining_today int, wait_seconds double"


def check(session_used: Column, last_at: Column, now: Column, used_today: Column, guard: bool = True, per_session: int = PER_SESSION, per_day: int = PER_DAY, gap: float = GAP_SECONDS) -> Column:
    """struct(ok, reason, message, remaining_today, wait_seconds) without consuming anything. last_at and now in seconds."""
    left = F.greatest(F.lit(per_day) - used_today, F.lit(0))
    wait = F.coalesce(F.lit(float(gap)) - (now - last_at), F.lit(0.0))
    reason = F.lit("") if not guard else F.when(session_used >= per_session, "session").when(left <= 0, "daily").when(wait > 0, "gap").otherwise("")
    midnight = F.lit(86400) - F.pmod(F.floor(now), F.lit(86400))
    message = (
        F.when(reason == "session", F.lit(f"Session limit reached: {per_session} answers per visit."))
        .when(reason == "daily", F.concat(F.lit(f"Quota of {per_day} answers used for today. It resets in "), X.format_wait(midnight), F.lit(" (calendar day, UTC).")))
        .when(reason == "gap", F.concat(F.lit("Please wait "), F.format_string("%.0f", wait), F.lit(" more seconds between questions.")))
        .otherwise("")
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"), message.alias("message"), left.cast("int").alias("remaining_today"), F.when(reason == "gap", wait).otherwise(0.0).alias("wait_seconds"))


def used_by_day(admitted: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, used) of admitted requests."""
    return admitted.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("used"))


def remaining(used: Column, per_day: int = PER_DAY) -> Column:
    return F.greatest(F.lit(per_day) - used, F.lit(0))


def admit_by_session(events: DataFrame, session: str = "session", ts: str = "ts", event: str = "event_id", per_session: int = PER_SESSION, gap: float = GAP_SECONDS) -> DataFrame:
    """(session, event, ts, ok, reason, used): session cap and gap, without the daily cap.

    Each decision depends on the last admitted request of its session, so sessions are dealt out, sorted with spilling and
    streamed past a state of two numbers: no session is gathered, however many requests it has.  A null time never waits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, last = object(), 0, None
        for batch in batches:
            ok, reasons, counts = [], [], []
            for s, at in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != now:
                    now, used, last = s, 0, None
                reason = "session" if used >= per_session else "gap" if None not in (last, at) and gap - (at - last) / 1e6 > 0 else ""
                if not reason:
                    used, last = used + 1, at
                ok.append(not reason)
                reasons.append(reason)
                counts.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ok, pa.bool_()), pa.array(reasons, pa.string()), pa.array(counts, pa.int32())], names=["session", "event_id", "ts", "ok", "reason", "used"])

    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(session).alias("session"), F.col(event).cast("bigint").alias("event_id"), at.alias("ts"), F.unix_micros(at).alias("at"))
    kind = rows.schema["session"].dataType.simpleString()
    return rows.repartition("session").sortWithinPartitions("session", "at", "event_id").mapInArrow(run, f"session {kind}, event_id bigint, ts timestamp, ok boolean, reason string, used int")


class Gate:
    """The state of admission, in Python: for the ordered pass below and the stream."""

    def __init__(self, per_session: int = PER_SESSION, per_day: int = PER_DAY, gap: float = GAP_SECONDS):
        self.per_session, self.per_day, self.gap = per_session, per_day, gap
        self.sessions: dict = {}
        self.day, self.used = None, 0

    def __call__(self, session, at: float) -> tuple[bool, str, int, float]:
        day = int(at // 86400)
        if day != self.day:
            self.day, self.used = day, 0
        used, last = self.sessions.get(session, (0, None))
        left = max(0, self.per_day - self.used)
        if used >= self.per_session:
            return False, "session", left, 0.0
        if left <= 0:
            return False, "daily", 0, 0.0
        if last is not None and self.gap - (at - last) > 0:
            return False, "gap", left, self.gap - (at - last)
        self.used += 1
        self.sessions[session] = (used + 1, at)
        return True, "", left - 1, 0.0


def admit(events: DataFrame, session: str = "session", ts: str = "ts", event: str = "event_id", gate: Gate | None = None, **caps) -> DataFrame:
    """(session, event_id, ts, ok, reason, remaining_today, wait_seconds) under all three limits, going on from the state of `gate`, if there is one.

    One total order over all sessions decides, but only until a day is full: a session's first request of a day is admitted unless the session is
    used up (per_session of them were admitted before) or waits for its gap (it was admitted shortly before). So a day is full at the latest with the first request of so many
    sessions. What comes up to there is one ordered pass, sorted with spilling and streamed past the state of the admitted sessions. Every later request of the day is refused by the day, or by its session if that is used up by then: no order is needed.
    """
    start = gate or Gate(**caps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = Gate(start.per_session, start.per_day, start.gap)
        now.sessions, now.day, now.used = dict(start.sessions), start.day, start.used
        for pdf in batches:
            made = [now(s, t) for s, t in zip(pdf["session"], pdf["at"], strict=True)]
            yield pd.concat([pdf[["session", "event_id", "ts"]].reset_index(drop=True), pd.DataFrame(made, columns=["ok", "reason", "remaining_today", "wait_seconds"]).astype({"remaining_today": "int32"})], axis=1)

    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    day = lambda c: F.floor(seconds(c) / 86400).cast("bigint")
    rows = events.select(F.col(session).cast("bigint").alias("session"), F.col(event).cast("bigint").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))
    in_order = lambda part: part.withColumn("at", seconds("ts")).repartition(1).sortWithinPartitions("at", "event_id").mapInPandas(run, "session bigint, event_id bigint, ts timestamp, " + DECISION)
    if start.per_session <= 0:
        return in_order(rows)
    days = rows.agg(F.count_distinct(day("ts"))).first()[0]
    most = start.per_day * (1 + math.ceil(max(start.gap, 0) / 86400)) + start.per_day * days // start.per_session + len(start.sessions)
    firsts = rows.groupBy(day("ts").alias("day"), "session").agg(F.min(F.struct("ts", "event_id")).alias("cut"))
    cuts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("cut"))).where(F.col("n") <= most).where(F.col("n") == most).select("day", "cut")
    marked = rows.withColumn("day", day("ts")).join(F.broadcast(cuts), "day", "left")
    late = F.coalesce(F.struct("ts", "event_id") > F.col("cut"), F.lit(False))
    decided = written(in_order(marked.where(~late).select("session", "event_id", "ts")), "admitted")
    # sessions that are used up, and from which day on
    nth = F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id"))
    before = events.sparkSession.createDataFrame([(s, c) for s, (c, _) in start.sessions.items()], "session bigint, c bigint")
    full = decided.where("ok").withColumn("nth", nth).join(F.broadcast(before), "session", "left").where(F.col("nth") + F.coalesce("c", F.lit(0)) == start.per_session).select("session", day("ts").alias("since"))
    full = full.unionByName(before.where(F.col("c") >= start.per_session).select("session", F.lit(-(1 << 60)).cast("bigint").alias("since")))
    rest = marked.where(late).join(F.broadcast(full), "session", "left").withColumn("used_up", F.coalesce(F.col("since") <= F.col("day"), F.lit(False)))
    refused = rest.select("session", "event_id", "ts", F.lit(False).alias("ok"), F.when(F.col("used_up"), "session").otherwise("daily").alias("reason"), F.lit(0).alias("remaining_today"), F.lit(0.0).alias("wait_seconds"))
    return decided.unionByName(refused)
