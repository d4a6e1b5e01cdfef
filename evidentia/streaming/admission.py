"""Admission of a stream of requests: state that outlives batches, and counts by calendar day."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.index import scratch_path
from ..operators.quota import GAP_SECONDS, PER_SESSION, Gate, admit



def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a folder of Parquet files, so many a batch; a single file is read through its folder by name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Does the path name one file, not a folder? By Spark's own listing, which opens none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").first()
    return found is not None and found["path"].rpartition("/")[2] == path.rstrip("/").rpartition("/")[2]


def _run(df: DataFrame, out: str) -> DataFrame:
    """Runs an appending stream over all that is there and gives back what it wrote."""
    spark = df.sparkSession
    at = scratch_path(spark, out)
    df.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


DAYS = "used bigint, day date"


def count_days(spark: SparkSession, path: str, out: str, delay: str = "1 day", files_per_batch: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """((day, used) of all runs so far, {read, untimed, counted, late, days_kept} of this run): requests by calendar day (UTC), from the files that are new since the last run.

    State is bounded: a day's counter goes once the watermark, the latest time seen less `delay`, has passed its end. Requests for such a day are late: they change
    nothing and are counted apart. Each batch writes only the days that it changed, each into its own partition of out/days, over what stood
    there; a batch that runs again does the same.
    """
    spark.createDataFrame([], DAYS).write.mode("ignore").partitionBy("day").parquet(f"{out}/days")
    days = lambda: spark.read.schema(DAYS).parquet(f"{out}/days")
    total = lambda: days().agg(F.coalesce(F.sum("used"), F.lit(0))).first()[0]
    before = total()
    seen = file_stream(spark, path, files_per_batch).observe("requests", F.count(F.lit(1)).alias("read"), F.count_if(F.col("ts").isNull()).alias("untimed"))
    timed = seen.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("used")).select("used", F.to_date("window.start").alias("day"))
    write = lambda batch, _: batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/days")
    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    met = [p.observedMetrics["requests"] for p in query.recentProgress if "requests" in p.observedMetrics]
    read, untimed, counted = sum(m["read"] for m in met), sum(m["untimed"] for m in met), total() - before
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return days(), {"read": read, "untimed": untimed, "counted": counted, "late": read - untimed - counted, "days_kept": kept[-1] if kept else 0}


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, used) over the stream, in one run."""
    return count_days(spark, path, scratch_path(spark, "daily"))[0].select("day", "used")


class SessionGate(StatefulProcessor):
    """Admission of one session: its cap and its least gap; the number admitted and the time of the last are state that expires."""

    def __init__(self, per_session: int, gap: float, ttl_ms: int):
        self.per_session, self.gap, self.ttl_ms = per_session, gap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "used int, last bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        pdf = pd.concat(list(rows)).sort_values(["at", "event_id"], na_position="first")
        used, last = self.seen.get() if self.seen.exists() else (0, None)
        ok, reasons, counts = [], [], []
        for at in pdf["at"].tolist():
            at = None if pd.isna(at) else int(at)
            reason = "session" if used >= self.per_session else "gap" if None not in (last, at) and self.gap - (at - last) / 1e6 > 0 else ""
            if not reason:
                used, last = used + 1, at
            ok.append(not reason)
            reasons.append(reason)
            counts.append(used)
        self.seen.update((used, last))
        yield pd.DataFrame({"session": pdf["session"].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "ok": ok, "reason": reasons, "used": pd.Series(counts, dtype="int32")})

    def close(self) -> None:
        return


SESSION_OUT = "session bigint, event_id bigint, ok boolean, reason string, used int"
#: What a stream with expiring state needs: the RocksDB store, and no batches without data (they would go on for ever to expire state).
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def admit_sessions(events: DataFrame, per_session: int = PER_SESSION, gap: float = GAP_SECONDS, ttl: timedelta = timedelta(days=30)) -> DataFrame:
    """Decisions on a stream of (session, event_id, ts), each session by itself, as quota.admit_by_session gives them for a table.

    State is a pair of numbers a session; one that sends nothing for `ttl` is forgotten and begins anew. Requests of a session are taken in order of
    time within a batch, and batches in their order, so one batch and ten decide alike if files come in order of time. Start it inside `expiring`.
    """
    rows = events.select("session", F.col("event_id").cast("bigint").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("session").transformWithStateInPandas(SessionGate(per_session, gap, int(ttl.total_seconds() * 1000)), SESSION_OUT, "append", "processingTime")


@contextmanager
def expiring(spark: SparkSession) -> Iterator[None]:
    """Streams started inside have the settings STATE; the session's own ones come back at the end."""
    was = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def admit_sessions_once(spark: SparkSession, path: str, files_per_batch: int | None = None, **caps) -> DataFrame:
    events = file_stream(spark, path, files_per_batch).select(F.col("user_id").alias("session"), "event_id", "ts")
    with expiring(spark):
        return _run(admit_sessions(events, **caps), "sessions")


DECIDED = "session bigint, event_id bigint, ts timestamp, reason string, remaining_today int, batch bigint, ok boolean"


def gate_before(decided: DataFrame, number: int, **caps) -> Gate:
    """The state of admission after the batches below `number`: a pair of numbers for each session that was admitted, of which a day has per_day at most, and the last request's day."""
    gate, earlier = Gate(**caps), decided.where(F.col("batch") < number)
    order, at = F.struct("batch", "ts", "event_id"), F.unix_micros("ts") / F.lit(1e6)
    for s, c, t in earlier.where("ok").groupBy("session").agg(F.count("*"), F.max_by(at, order)).collect():
        gate.sessions[s] = (c, t)
    last = earlier.where(F.col("batch") == earlier.agg(F.max("batch")).first()[0]).agg(F.max_by(F.struct(at.alias("at"), "remaining_today"), order)).first()[0]
    if last is not None:
        gate.day, gate.used = int(last["at"] // 86400), gate.per_day - last["remaining_today"]
    return gate


def admit_stream_once(spark: SparkSession, path: str, files_per_batch: int | None = None, **caps) -> DataFrame:
    """Decisions on a stream of requests, as quota.admit gives them for a table. All limits share one state, for the daily cap orders all sessions; requests of a batch are taken in
    order of time, batches in their order. No task holds a batch; each writes its own partition, over what a crashed run of it has left."""
    out = scratch_path(spark, "admission")
    spark.createDataFrame([], DECIDED).write.partitionBy("batch", "ok").parquet(f"{out}/decided")
    decided = lambda: spark.read.schema(DECIDED).parquet(f"{out}/decided")

    def decide(batch: DataFrame, number: int) -> None:
        made = admit(batch, gate=gate_before(decided(), number, **caps)).withColumn("batch", F.lit(number).cast("bigint"))
        made.select("session", "event_id", "ts", "reason", "remaining_today", "batch", "ok").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "ok").parquet(f"{out}/decided")

    events = file_stream(spark, path, files_per_batch).select(F.col("user_id").alias("session"), "event_id", "ts")
    events.writeStream.foreachBatch(decide).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return decided().select("session", "event_id", "ok", "reason", "remaining_today")
