"""Recall and accuracy on held-out cases, and cases of scale in small."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import decontaminate, toxicity, urls, warc
from evidentia.llm._scratch import Scratch
from tests.llm.test_others import distance_in, edits, verdict

DATA = "/root/testdata/sf0.1"


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_leaks_against_all_pairs(spark):
    """Each document against each item by the plain table; items of 8 to 12 words, edits up to the ratio."""
    rng = random.Random(21)
    vocabulary = words_of(rng, 400)
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randrange(8, 13))) for i in range(12)]
    docs = [(j, prose(4) + " " + edits(items[j % 12][1], int(rng.choice([0, 0.05, 0.1, 0.15]) * len(items[j % 12][1])), rng) + " " + prose(4) if j % 4 else prose(18)) for j in range(60)]
    want = {}
    for j, text in docs:
        folded = decontaminate.fold(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tobytes().decode()
        for i, item in items:
            d = distance_in(item, folded)
            if d <= int(0.15 * len(item)):
                want[j, i] = d
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and len(want) > 30
    assert all(got[p] >= want[p] for p in got) and sum(got[p] == want[p] for p in got) >= 0.95 * len(got)


def test_many_items_go_in_tables_and_passes(spark, monkeypatch):
    rng = random.Random(22)
    vocabulary = words_of(rng, 3000)
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(20)) for i in range(300)]
    docs = [(j, prose(10) + " " + items[j][1] + " " + prose(10), 1) for j in range(0, 300, 7)] + [(None, items[5][1], 1), (1000, items[6][1], 1), (1000, items[6][1], 1), (1001, prose(40), 1)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(df, it).collect()), key=str)
    assert len(whole) == 43 + 3 and [r for r in whole if r[0] == 1000] == [(1000, 6, 0, len(items[6][1]), 0)] * 2
    clean = [r["doc_id"] for r in decontaminate.drop_contaminated(df, it).collect()]
    assert clean == [1001]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 5_000)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 15_000)
    assert sorted(map(tuple, decontaminate.contaminated(df, it).collect()), key=str) == whole
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(df, it).collect()] == [1001]


def test_long_items_and_long_words(spark):
    rng = random.Random(23)
    vocabulary = words_of(rng, 3000)
    long = " ".join(rng.choice(vocabulary) for _ in range(18_000))
    blob = "".join(rng.choice("0123456789abcdef") for _ in range(900))
    eight = " ".join(blob[i : i + 100] for i in range(0, 800, 100))
    items = [(1, long), (2, eight), (3, blob)]
    changed = "".join(c if i % 25 else "z" for i, c in enumerate(eight))
    docs = [(1, "before " + edits(long, 900, rng) + " after"), (2, "x " + changed + " y"), (3, f"see {blob} here"), (4, long[:50_000])]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (3, 3)}  # the third holds all of the second item but its spaces


def test_decontamination_stage_needs_no_ids(spark, tmp_path):
    rng = random.Random(24)
    vocabulary = words_of(rng, 500)
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = prose(25)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(5) + " " + item, "en", "s", 1), (None, prose(30), "en", "s", 1), (7, item, "en", "s", 1), (7, prose(30), "en", "s", 1), (8, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    assert corpus_pipeline.decontamination(spark, docs.limit(0), str(tmp_path)).count() == 0
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup):
        assert stage(spark, docs, str(tmp_path)).count() == 5 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.sequence_packing(spark, docs, str(tmp_path)).count() >= 5


def test_one_payload_for_all_pages(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.lit("<p>same</p>").alias("html"))
    archive = warc.write_archive(pages, Scratch(spark, "hot"))
    assert archive.objects.count() == 1
    got = warc.resolve_revisits(warc.read_archive(archive), Scratch(spark, "hot")).groupBy("record_type", "refers_to", "payload_bytes").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([("response", None, 11, 1), ("revisit", 2999, 11, 2999)], key=str)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the shared tables")
def test_held_out_toxicity(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.held_out(F.col("doc_id"))
    machine = toxicity.train(docs, labels.where(~held))
    got = toxicity.score(docs.join(labels.where(held), "doc_id"), machine).select("toxic", (F.col("score") >= 0.5).cast("int").alias("p")).groupBy("toxic", "p").count().collect()
    n = {(r["toxic"], r["p"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.8 and n.get((0, 1), 0) <= 0.005 * n[0, 0], n


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the shared tables")
def test_held_out_urls(spark):
    """Trees fitted on four fifths of the URLs that the rules decide, without the rules, judge the other fifth."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").where("url is not null")
    rows = [(r["page_id"], r["url"], verdict(r["url"])[3]) for r in pages.collect()]
    known = spark.createDataFrame([(i, u, int(a == "block")) for i, u, a in rows if a], "page_id bigint, url string, label int")
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    judged = urls.url_verdicts(known.where(fold == 0), [], labels=known.where(fold != 0).select("url", "label")).join(known.select("page_id", "label"), "page_id")
    n = {(r["label"], r["verdict"]): r["count"] for r in judged.groupBy("label", "verdict").count().collect()}
    # what the rules decide hangs on hosts and paths that lexical features hardly show: no worse than the larger class is all that can be asked
    total, bad = sum(n.values()), n.get((1, "block"), 0) + n.get((1, "allow"), 0)
    assert n.get((1, "block"), 0) + n.get((0, "allow"), 0) >= max(bad, total - bad) - 0.02 * total, n
