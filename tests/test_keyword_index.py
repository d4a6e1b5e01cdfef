"""The stored index in cells: exact against the scan, read by bucket, and kept for readers while a new one is built."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import index, keyword_index, lexical

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n, seed, key=lambda i: i):
    rng = random.Random(seed)
    rows = [(key(i), " ".join(rng.choices(WORDS, [1 / (1 + j) for j in range(60)], k=rng.choice([0, 3, 10, 40]))) or None, f"t{i % 9} {rng.choice(WORDS)}", rng.choice(["A", "B", None]), rng.choice(["x", "y", None])) for i in range(n)]
    rows += [(key(7), "w1 w2 w2 again", "t7", rows[7][3], rows[7][4])]  # a repeated key is one document
    kind = "string" if isinstance(key(0), str) else "bigint"
    return spark.createDataFrame(rows, f"chunk_id {kind}, page_content string, title_text string, doc_family string, doc_role string")


def asked(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 5, 20])))) for i in range(40)] + [(90, None), (91, ""), (92, "unknown words"), (93, "w3 w3 w3")]
    return spark.createDataFrame(rows, "query_id bigint, question string")


def order(rows):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in rows)


def one_per_key(docs):
    """The documents as the index counts them: repeated keys joined."""
    return docs.groupBy("chunk_id").agg(F.array_join(F.collect_list("page_content"), " ").alias("page_content"), F.array_join(F.collect_list("title_text"), " ").alias("title_text"), F.first("doc_family").alias("doc_family"), F.first("doc_role").alias("doc_role"))


@pytest.mark.parametrize("cell, tokens, block", [(50, 2_000_000, 4), (4096, 300, 16), (4096, 2_000_000, 128)])
def test_top_k_is_that_of_the_scan(spark, tmp_path, monkeypatch, cell, tokens, block):
    """Also in tiny cells and blocks, where most blocks are skipped by their bounds, and with routes inside the cells."""
    for name, value in (("CELL", cell), ("CELL_TOKENS", tokens), ("BLOCK", block)):
        monkeypatch.setattr(keyword_index, name, value)
    docs, q = corpus(spark, 700, cell), asked(spark, cell)
    stored = keyword_index.ensure(docs, ["page_content", "title_text"], str(tmp_path / "kw"), "s")
    whole = one_per_key(docs)
    for field in ("page_content", "title_text"):
        scores = lexical.bm25_scores(whole, q, field).persist()
        for k in (1, 10, 1000):
            assert order(stored.top_k(q, k, field).collect()) == order(lexical.top_k(scores, k).collect())
        rules = spark.createDataFrame([(i, ["A", None, "B"][i % 3], ["x", "y"][i % 2], bool(i % 4)) for i in range(30)], "query_id bigint, family string, role string, by_role boolean")
        marked = scores.join(whole, "chunk_id").join(rules, "query_id", "left")
        kept = marked.where("by_role is null or ((family is null or coalesce(family = doc_family, false)) and (not by_role or coalesce(role = doc_role, false)))").select("query_id", "chunk_id", "score")
        assert order(stored.top_k(q, 5, field, rules=rules).collect()) == order(lexical.top_k(kept, 5).collect())
        scores.unpersist()


def test_batches_of_questions_and_other_keys(spark, tmp_path, monkeypatch):
    docs, q = corpus(spark, 300, 3, key=lambda i: f"d{i:03}"), asked(spark, 5)
    stored = keyword_index.ensure(docs, ["page_content"], str(tmp_path / "kw"), "s")
    want = order(stored.top_k(q, 7).collect())
    assert want == order(lexical.bm25_top_k(one_per_key(docs), q, 7).collect())
    monkeypatch.setattr(keyword_index, "QUERIES", 10)
    assert order(stored.top_k(q, 7).collect()) == want
    text_ids = q.withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in stored.top_k(text_ids, 7).collect()} == {(f"q{a}", b, c) for a, b, c, _ in want}


def metric(df, node, name):
    """The sum of a metric over the nodes of an executed plan whose names begin so."""
    jvm = df.sparkSession.sparkContext._jvm
    df._jdf.queryExecution().toRdd().count()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.nodeName().startswith(node) and p.metrics().contains(name):
            total += p.metrics().apply(name).value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert jvm is not None
    return total


def test_questions_read_their_buckets_and_make_no_pairs(spark, tmp_path):
    docs = corpus(spark, 3000, 11)
    stored = keyword_index.ensure(docs, ["page_content", "title_text"], str(tmp_path / "kw"), "s")
    every = len(stored.packed.where("field = 'page_content'").inputFiles())
    one = spark.createDataFrame([(1, "w5"), (2, "w6 w5")], "query_id bigint, question string")
    found = stored.top_k(one, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "bucket" in plan.split("PartitionFilters")[1]
    assert metric(found, "Scan parquet", "numFiles") <= 4 < every  # the cells' own rows and two buckets of terms
    many = asked(spark, 2)
    pairs = stored.scores(many).count()
    sent = stored._searched(many, 10, "page_content", None, "question").count()
    assert sent * 10 <= pairs


def test_a_new_state_is_built_beside_readers(spark, tmp_path):
    path, q = str(tmp_path / "kw"), asked(spark, 1)
    old = keyword_index.ensure(corpus(spark, 50, 1), ["page_content"], path, "monday")
    reader = old.top_k(q, 5)
    new = keyword_index.ensure(corpus(spark, 80, 2), ["page_content"], path, "tuesday")
    assert new.path != old.path and new.docs.count() == 80
    assert order(reader.collect()) == order(keyword_index.open_keyword_index(spark, path, "monday").top_k(q, 5).collect())
    assert index.drop_others(spark, path, "tuesday") == 1
    with pytest.raises(FileNotFoundError):
        keyword_index.open_keyword_index(spark, path, "monday")
    assert keyword_index.open_keyword_index(spark, path, "tuesday").docs.count() == 80
