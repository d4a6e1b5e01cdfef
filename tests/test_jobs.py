import json
import logging
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import ingest_chunks, search_quality

ROOT = Path(__file__).resolve().parent.parent
TEXT = "\n".join(["3.1 Valve requirements", *[f"Valve {i} shall be tested at {i} bar for ten minutes before delivery." for i in range(40)], "3.2 Records", "Each test is recorded and kept for five years by the supplier of the valve."])


def arrive(spark, folder, name, rows):
    """One more file in the folder, as a delivery of it would come."""
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}-{name}")
    Path(folder).mkdir(exist_ok=True)
    for k, part in enumerate(sorted(Path(f"{folder}-{name}").glob("part-*"))):
        shutil.move(part, f"{folder}/{name}-{k}.parquet")


def rows_of(made):
    return sorted(map(tuple, made.select("doc_id", "lang", "seq", "piece", "tokens", "page_content").collect()), key=str)


def stored(out, name):
    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in Path(out, name).rglob("*.parquet")}


FIRST = [(1, TEXT, "en", "a", 0), (2, "Scope:\nThis text covers pumps and their seals in some detail for the reader.", "de", "a", 0), (3, None, "en", "b", 0), (4, "", None, "b", 0), (None, "nobody can name this document, so it is left out", "en", "b", 0)]
SECOND = [(2, "Scope:\nThis text now covers compressors and their bearings instead of anything else.", "fr", "a", 0), (5, TEXT.replace("Valve", "Pump"), None, "b", 0), (1, TEXT, "en", "a", 0), (5, TEXT.replace("Valve", "Pump"), None, "b", 0), (6, "word " * 3000, "en", "b", 0)]


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    arrive(spark, docs, "one", FIRST)
    config = {"window": 64, "min_tokens": 5}
    first = rows_of(ingest_chunks.run(spark, docs, out, config))
    assert {r[0] for r in first} == {1, 2} and len([r for r in first if r[0] == 1]) > 5
    before = stored(out, "chunks")
    assert rows_of(ingest_chunks.run(spark, docs, out, config)) == first and stored(out, "chunks") == before  # nothing new: nothing written

    arrive(spark, docs, "two", SECOND)
    second = rows_of(ingest_chunks.run(spark, docs, out, config))
    # of the second delivery the unchanged document isn't taken, the repeated one once
    taken = {r["doc_id"]: r["ingest"] for r in ingest_chunks.taken(spark, out).collect()}
    assert taken == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1}
    assert {k: v for k, v in stored(out, "chunks").items() if k in before} == before  # earlier files stay untouched
    # the same as one run over everything, whatever batch a document came in
    whole = str(tmp_path / "whole")
    assert rows_of(ingest_chunks.run(spark, docs, whole, config | {"files_per_batch": 1})) == second
    latest = [r for r in second if r[0] == 2]
    assert latest and all("compressors" in r[5] and r[1] == "fr" for r in latest)


def test_ingest_after_a_crash_gives_the_same(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    arrive(spark, docs, "one", FIRST)
    ingest_chunks.run(spark, docs, out)
    arrive(spark, docs, "two", SECOND)
    want = rows_of(ingest_chunks.run(spark, docs, out))
    # as if the driver had died with the chunks of batch 1 written, but neither what was taken nor the commit
    shutil.rmtree(f"{out}/taken/ingest=1")
    for f in [f"{out}/checkpoint/commits/1", f"{out}/checkpoint/commits/.1.crc"]:
        os.path.exists(f) and os.remove(f)
    assert {r[0] for r in rows_of(ingest_chunks.current(spark, out))} == {1, 2}  # readers don't see the half of it that stands there
    assert rows_of(ingest_chunks.run(spark, docs, out)) == want
    assert rows_of(spark.read.schema(ingest_chunks.CHUNKS).parquet(f"{out}/chunks").where("ingest = 1")) == [r for r in want if r[0] in (2, 5, 6)]


def test_ingest_of_no_rows(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    arrive(spark, docs, "one", [])
    assert ingest_chunks.run(spark, docs, out).count() == 0
    arrive(spark, docs, "two", FIRST)
    assert ingest_chunks.run(spark, docs, out).count() > 0


def test_search_quality(spark, tmp_path, caplog):
    docs = [(i, f"report {i} says that pump number {i} was repaired in week {i} of the year", "en" if i % 2 else None) for i in range(30)]
    docs += [(50, None, "de"), (51, "", "de"), (None, "report 3 says that pump number 3 was repaired", "de"), (7, "another text under the same id", "en")]
    asked = [(1, "says that pump number 3 was repaired"), (2, "no such words anywhere whatsoever zzz"), (3, None), (4, "pump number 7 was repaired in week 7")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{tmp_path}/asked")
    out = str(tmp_path / "out")
    with caplog.at_level(logging.INFO, "jobs.search_quality"):
        made = search_quality.run(spark, f"{tmp_path}/docs", f"{tmp_path}/asked", out)
    first = sorted(map(tuple, made.collect()), key=str)
    index = stored(out, "index")
    again = search_quality.run(spark, f"{tmp_path}/docs", f"{tmp_path}/asked", out)
    assert sorted(map(tuple, again.collect()), key=str) == first and stored(out, "index") == index  # the index is opened, not built anew
    made = again
    best = {r["query_id"]: r for r in made.where("rank = 1").collect()}
    assert best[1]["doc_id"] == 3 and best[1]["supported"] and best[4]["doc_id"] == 7 and best[4]["supported"] and 2 not in best and 3 not in best
    assert made.groupBy("query_id", "rank").count().where("count > 1").count() == 0
    rates = search_quality.rates(made, spark.read.parquet(f"{tmp_path}/asked").select(F.col("item_id").alias("query_id")), 10).first()
    assert (rates["questions"], rates["hit_1"], rates["hit_10"], rates["mrr"]) == (4, 0.5, 0.5, 0.5)
    assert "read" in caplog.text and "wrote" in caplog.text and "rates" in caplog.text
    # other documents: the index is built anew, and the output is that of the new state alone
    spark.createDataFrame([(60, "the valve is red and says that pump number 3 was repaired", "en")], "doc_id bigint, text string, lang string").write.mode("append").parquet(f"{tmp_path}/docs")
    later = search_quality.run(spark, f"{tmp_path}/docs", f"{tmp_path}/asked", out)
    assert later.where("doc_id = 60 and query_id = 1 and supported").count() == 1


@pytest.mark.parametrize("job", ["ingest_chunks", "search_quality"])
def test_command_line(spark, tmp_path, job):
    arrive(spark, str(tmp_path / "docs"), "one", FIRST)
    spark.createDataFrame([(1, "This text covers pumps and their seals")], "item_id bigint, text string").write.parquet(f"{tmp_path}/asked")
    (tmp_path / "config.json").write_text(json.dumps(json.loads((ROOT / "jobs" / f"{job}.json").read_text())))
    more = ["--questions", f"{tmp_path}/asked"] if job == "search_quality" else []
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--documents", f"{tmp_path}/docs", *more, "--out", f"{tmp_path}/out", "--config", f"{tmp_path}/config.json"], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job} " in done.stderr or "__main__" in done.stderr or "read" in done.stderr
    name = "chunks" if job == "ingest_chunks" else "excerpts"
    assert spark.read.parquet(f"{tmp_path}/out/{name}").count() > 0
