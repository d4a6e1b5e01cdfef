"""Sessions as a stream with expiring state, and days behind a watermark."""

import shutil
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from evidentia.operators import quota
from evidentia.streaming import admission

SCHEMA = "user_id bigint, event_id bigint, ts timestamp"
START = datetime(2024, 3, 1)


def arrive(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    Path(folder).mkdir(exist_ok=True)
    shutil.move(next(Path(f"{folder}-{name}").glob("part-*")), f"{folder}/{name}.parquet")


def test_one_batch_and_ten_decide_alike(spark, tmp_path):
    folder, rows = str(tmp_path / "events"), [(i * i % 7, i, START + timedelta(seconds=i * 311)) for i in range(400)] + [(90, 1000, None), (90, 1001, None), (None, 1002, START)]
    for k in range(10):
        arrive(spark, folder, f"{k}", rows[k * 40 : (k + 1) * 40 if k < 9 else None])
    before = {name: spark.conf.get(name, None) for name in admission.STATE}
    key = lambda made: sorted(map(tuple, made.select("session", "event_id", "ok", "reason", "used").collect()), key=str)
    caps = {"per_session": 20, "gap": 1000.0}
    one = key(admission.admit_sessions_once(spark, folder, **caps))
    assert key(admission.admit_sessions_once(spark, folder, files_per_batch=1, **caps)) == one
    assert key(quota.admit_by_session(spark.read.parquet(folder).withColumnRenamed("user_id", "session"), **caps)) == one
    assert {r[3] for r in one} == {"", "gap", "session"} and len(one) == len(rows)
    assert {name: spark.conf.get(name, None) for name in admission.STATE} == before


def test_days_close_behind_the_watermark(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    day = lambda n, hour=1: START + timedelta(days=n, hours=hour)
    arrive(spark, folder, "1", [(1, i, day(0)) for i in range(3)] + [(1, 10, day(1)), (1, 11, None)])
    days, run = admission.count_days(spark, folder, out)
    used = lambda: {(r["day"] - START.date()).days: r["used"] for r in days.collect()}
    assert used() == {0: 3, 1: 1} and (run["counted"], run["late"]) == (4, 0)
    arrive(spark, folder, "2", [(1, 12, day(0, 20)), (2, 13, day(30))])  # day 0 is still open, then the watermark goes far ahead
    days, run = admission.count_days(spark, folder, out)
    assert used() == {0: 4, 1: 1, 30: 1} and run["late"] == 0
    arrive(spark, folder, "3", [(1, 14, day(0, 21)), (1, 15, day(1)), (3, 16, day(30))])  # two are late: they change nothing
    before = {p: p.stat().st_mtime_ns for p in Path(out, "days").glob("day=2024-03-0*/*.parquet")}
    days, run = admission.count_days(spark, folder, out)
    assert used() == {0: 4, 1: 1, 30: 2} and (run["read"], run["counted"], run["late"]) == (3, 1, 2) and run["days_kept"] == 1
    assert {p: p.stat().st_mtime_ns for p in Path(out, "days").glob("day=2024-03-0*/*.parquet")} == before
    days, run = admission.count_days(spark, folder, out)  # nothing new
    assert used() == {0: 4, 1: 1, 30: 2} and run["read"] == 0
    assert days.where(F.col("used") > 0).count() == 3
