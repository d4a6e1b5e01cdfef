"""Queries on odd and hot tables, held against their SQL."""

import pytest

import __spark_entry__ as entry


def tables(spark, folder, **rows):
    """Parquet tables (schema, rows) in a folder, as the queries read them."""
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    """(rows of the query, rows of its SQL), each sorted."""
    con = pytest.importorskip("duckdb").connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    made = entry.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, made.collect()), key=str), sorted(want, key=str)


DOCS, BENCH = "doc_id bigint, text string, lang string, source string", "item_id bigint, text string"


def test_excerpts_are_written_as_the_sql_writes_them(spark, tmp_path):
    docs = [(1, "pump seal\n3.1 Scope of pumps\n4.2.1 Seals", "en", "src1"), (2, "pump seal valve", None, "src2"), (3, "pump valve", "", "src3"), (4, "pump pump", "de", None), (5, "pump 7", "de", "src5"), (6, "flange", None, "src6")]
    tables(spark, tmp_path, documents=(DOCS, docs), benchmark=(BENCH, [(1, "pump seal"), (2, "valve"), (3, "flange"), (4, "nothing")]))
    got, want = against_sql(spark, tmp_path, "format_excerpts")
    assert got == want and len(got) == 3


def test_vectors_meet_as_matrices(spark, tmp_path):
    import numpy as np

    from evidentia.operators import vectors

    rng = np.random.default_rng(5)
    v = [(i, (rng.normal(size=4) * (i % 7 > 0)).tolist()) for i in range(3000)] + [(i, None) for i in range(3000, 3040)]
    v[17], v[18], v[19], v[20] = (17, [float("nan"), 1.0, 0.0, 0.0]), (18, [None, 1.0, 0.0, 0.0]), (19, [9.0]), (20, [float("inf"), 1.0, 1.0, 1.0])
    q = [(i, rng.normal(size=4).tolist()) for i in range(700)] + [(700, None), (701, [2.0]), (702, [0.0] * 4)]
    p, asked = spark.createDataFrame(v, "chunk_id bigint, vec array<double>"), spark.createDataFrame(q, "query_id bigint, vec array<double>")
    made = vectors.vector_top_k(p, asked, 5)
    assert "CartesianProduct" not in made._jdf.queryExecution().toString() and "MapInArrow" in made._jdf.queryExecution().toString()
    pairs = asked.withColumnRenamed("vec", "q").crossJoin(p).select("query_id", "chunk_id", vectors.dot(p["vec"], "q").alias("score"))
    rounded = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], repr(r["score"] if r["score"] is None else round(r["score"], 8))) for r in df.collect())
    got = rounded(made)
    assert got == rounded(vectors.rank_scored(pairs, 5)) and len(got) == 703 * 5


def test_no_task_reads_a_whole_ingest(spark, tmp_path):
    from jobs import ingest_chunks

    docs = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"text number {i}", "en") for i in range(40)], "doc_id bigint, text string, lang string").write.parquet(docs)
    ingest_chunks.run(spark, docs, str(tmp_path / "out"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # tables larger than that, as large ones are
    try:
        made = ingest_chunks.current(spark, str(tmp_path / "out"))
        exchanges = [line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(ingest" in line and "ENSURE" in line]
        sides = [line for line in exchanges if "doc_id" not in line]
        # the one left counts the numbers themselves
        assert len(sides) <= 1 and made.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def shuffled(spark) -> int:
    """Bytes that this session's tasks have written for shuffles."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def long_texts(words, docs=600, seed=3):
    """Long texts of few different words, whose postings are small."""
    import random

    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(words) for _ in range(4000)), "en", f"src{i % 3}") for i in range(docs)]


def test_the_keyword_index_shuffles_no_tokens(spark, tmp_path):
    from evidentia.operators import keyword_index, lexical

    words = [f"term{i}" for i in range(12)]
    rows = [(i, t) for i, t, _, _ in long_texts(words)]
    q = spark.createDataFrame([(1, "term1 term5"), (2, "rare term2"), (3, "twin")], "query_id bigint, question string")
    chunks = spark.createDataFrame(rows + [(600, "rare words"), (601, None)], "chunk_id bigint, page_content string")
    chunks.write.parquet(str(tmp_path / "c"))
    chunks, before = spark.read.parquet(str(tmp_path / "c")).repartition(6).localCheckpoint(), shuffled(spark)
    before = shuffled(spark)
    made = keyword_index.ensure(chunks, ["page_content"], str(tmp_path / "k"), "once")
    assert shuffled(spark) - before < 600_000  # the tokens are 2,400,000
    same = lambda df: [(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 8)) for r in df.orderBy("query_id", "rank").collect()]
    assert same(made.top_k(q, 20)) == same(lexical.bm25_top_k(chunks, q, 20))
    # rows that share a key, null keys among them, are one document wherever they stand
    twins = spark.createDataFrame([(7, "twin one"), (None, "twin null"), (7, "two three"), (8, "four"), (None, "five twin")], "chunk_id bigint, page_content string").repartition(4)
    index = keyword_index.ensure(twins, ["page_content"], str(tmp_path / "k"), "twins")
    assert sorted((r["chunk_id"] or 0, r["dl"]) for r in index.docs.collect()) == [(0, 4), (7, 4), (8, 1)]
    assert {r["term"]: r["n"] for r in index.postings.groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()}["twin"] == 2


def test_excerpts_meet_texts_without_shuffling_them(spark, tmp_path):
    import random

    rng = random.Random(1)
    docs = [(i, f"pump{i % 50} " + " ".join(f"{rng.getrandbits(40):x}" for _ in range(1500)), "en", f"src{i % 3}") for i in range(300)]
    tables(spark, tmp_path, documents=(DOCS, docs), benchmark=(BENCH, [(i, f"pump{i} seal") for i in range(10)]))
    from evidentia.plans import base

    base.keyword_index(spark, str(tmp_path))
    before = shuffled(spark)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000000")  # the texts are 5 MB
    try:
        got, want = against_sql(spark, tmp_path, "verify_claims")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == want and len(got) == 30
    assert shuffled(spark) - before < 2_000_000


def test_full_days_need_no_order(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from evidentia.operators import quota
    from evidentia.streaming import admission

    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(rng.choice([1, 2, 3, rng.randrange(400)]), i, start + timedelta(seconds=rng.randrange(6 * 86400))) for i in range(6000)]
    caps = {"per_session": 4, "per_day": 7, "gap": 900.0}
    gate, want = quota.Gate(**caps), {}
    epoch = datetime(1970, 1, 1)
    for s, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = gate(s, (t - epoch).total_seconds())
    events = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp")
    path = str(tmp_path / "events.parquet")
    events.coalesce(1).write.parquet(path)
    made = quota.admit(spark.read.parquet(path).withColumnRenamed("user_id", "session"), **caps)
    assert {r["event_id"]: (r["ok"], r["reason"], r["remaining_today"], r["wait_seconds"]) for r in made.collect()} == want
    assert {w[1] for w in want.values()} == {"", "gap", "daily", "session"}
    assert not hasattr(admission, "admit_stream")  # no state that gathers a whole batch
    split = str(tmp_path / "split")
    for k in range(3):  # in order of time, two days each
        part = events.where((F.col("ts") >= F.lit(start + timedelta(days=2 * k))) & (F.col("ts") < F.lit(start + timedelta(days=2 * k + 2))))
        part.coalesce(1).write.mode("append").parquet(split)
    for folder, n in ((path, None), (split, 1)):
        got = {r["event_id"]: (r["ok"], r["reason"], r["remaining_today"]) for r in admission.admit_stream_once(spark, folder, files_per_batch=n, **caps).collect()}
        assert got == {i: w[:3] for i, w in want.items()}


def test_late_interaction_copies_one_row_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from evidentia.operators import vectors

    rng = np.random.default_rng(6)
    q, p = [rng.normal(size=(3, 16)) for _ in range(200)], [rng.normal(size=(100, 16)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(range(200)), pa.array([x.tolist() for x in q]), pa.array([x.tolist() for x in p])], names=["query_id", "chunk_id", "q", "p"])
    tracemalloc.start()
    made = list(vectors._best_matches(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000  # the batch is 2.6 MB
    assert np.allclose(made[0].column("best").to_pylist(), [(a @ b.T).max(1) for a, b in zip(q, p)])


def test_candidates_meet_texts_without_shuffling_them(spark, tmp_path):
    import random

    rng = random.Random(2)
    docs = [(i, f"pump{i % 50} " + " ".join(f"{rng.getrandbits(40):x}" for _ in range(1500)), ["en", "de"][i % 2], f"src{i % 3}") for i in range(300)]
    vecs = [(i, [rng.random() for _ in range(4)], i % 3) for i in range(300)]
    tables(spark, tmp_path, documents=(DOCS, docs), benchmark=(BENCH, [(i, f"pump{i} seal") for i in range(10)]), embeddings=("vec_id bigint, embedding array<float>, label int", vecs))
    from evidentia.plans import base

    base.keyword_index(spark, str(tmp_path))
    base.stored_vectors(spark, str(tmp_path), "family")
    before = shuffled(spark)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000000")  # the texts are 5 MB
    try:
        got, want = against_sql(spark, tmp_path, "cross_rerank")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == want and len(got) > 50
    assert shuffled(spark) - before < 2_000_000


def test_tokens_of_workers_are_those_of_spark(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from evidentia.functions import text as X
    from evidentia.operators import lexical

    texts = ["", "-.-", "--a", "a-", "-a.b-", "Pumps glass gas buses as ass", "s", "ss sss bus", "K\u212a \u0130x \u00c4rger\u00dfs pumps", "a\u00e9b\n\tc.d-e..", "x", ".", "end", "s-717v2.", None, "\U0001f600pumps\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lexical.lower("t").alias("low"), X.tokenize(F.col("t")).alias("want")).orderBy("i").collect()
    low = pa.array([r["low"] for r in rows])
    assert lexical.arrow_tokens(low).to_pylist() == [r["want"] for r in rows]
    assert lexical.arrow_tokens(low.slice(3, 9)).to_pylist() == [r["want"] for r in rows[3:12]] and lexical.arrow_tokens(low.slice(0, 0)).to_pylist() == []
    parts = list(lexical.tokenized(iter([pa.RecordBatch.from_arrays([low], names=["tokens"])])))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [r["want"] for r in rows]


def test_scores_are_made_where_the_texts_are_read(spark, tmp_path):
    words = [f"pump{i}" for i in range(12)]
    docs = [(i, t[: 40 + 40 * (i % 50)], lang, source) for i, t, lang, source in long_texts(words, 4000)]
    odd = [(4000, "", "en", "x"), (4001, None, "en", "x"), (4002, "valve only", "en", "x"), (7, "pump1 twin", "en", "x"), (7, "other words", "de", "x"), (None, "pump2 null", "en", "x"), (None, "pump2 again null", "en", "x")]
    asked = [(i, " ".join(words[i % 12 :][:3])) for i in range(30)] + [(40, "unknown"), (41, None), (42, "twins null"), (1, "pump1 valve")]
    tables(spark, tmp_path, benchmark=(BENCH, asked))
    spark.createDataFrame(docs + odd, DOCS).repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    got, want = against_sql(spark, tmp_path, "bm25_scores")
    assert len(got) == len(want) > 60_000 and [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
    assert shuffled(spark) - before < 500_000  # the rows alone are more
    none = tmp_path / "none"
    none.mkdir()
    tables(spark, none, documents=(DOCS, docs[:3]), benchmark=(BENCH, [(1, None)]))
    assert against_sql(spark, none, "bm25_scores") == ([], [])


def test_titles_are_searched_without_an_index_of_the_texts(spark, tmp_path):
    import os

    from evidentia.plans import base

    docs = [(i, f"Scope of pump{i % 7}\n" + "seal valve " * 20, ["en", "de"][i % 2], f"src{i % 3}") for i in range(60)]
    tables(spark, tmp_path, documents=(DOCS, docs), benchmark=(BENCH, [(1, "pump3 scope"), (2, "seal"), (3, "de")]))
    known = set(base._indexes)
    got, want = against_sql(spark, tmp_path, "title_bm25")
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) == 20
    (made,) = set(base._indexes) - known
    assert len(os.listdir(base._indexes[made].removeprefix("file://"))) == 1
    fields = lambda stored: sorted(r["field"] for r in stored.packed.select("field").distinct().collect())
    assert fields(base.keyword_index(spark, str(tmp_path), "title_text")) == ["title_text"]
    assert fields(base.keyword_index(spark, str(tmp_path))) == ["page_content", "title_text"]


def test_the_whole_search_builds_no_index_for_one_batch(spark, tmp_path):
    import random

    from evidentia.plans import base

    rng = random.Random(7)
    lines = lambda i: f"Scope of pump{i % 50}\n" + " ".join(f"{rng.getrandbits(40):x}" for _ in range(1500))
    docs = [(i, lines(i), ["en", "de", "fr", None][i % 4], [f"src{i % 20}", None][i % 9 == 0]) for i in range(300)] + [(300, None, "en", "src1"), (301, "", "de", "src2"), (None, "pump1 seal", "en", "src3")]
    vecs = [(i, [rng.random() for _ in range(4)], i % 3) for i in range(310)]
    tables(spark, tmp_path, benchmark=(BENCH, [(i, f"pump{i} scope seal") for i in range(24)]), embeddings=("vec_id bigint, embedding array<float>, label int", vecs))
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    before, known = shuffled(spark), set(base._indexes)
    got, want = against_sql(spark, tmp_path, "late_rerank")
    assert got == want and len(got) > 400
    assert set(base._indexes) == known
    assert shuffled(spark) - before < 1_000_000  # the texts are 5 MB


def test_first_of_each_task_are_the_first_of_all(spark, monkeypatch):
    import random

    from evidentia.operators import fusion, lexical

    monkeypatch.setattr(lexical, "SCORES", 300)  # a few rows at a time
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([3, 30])]) for _ in range(rng.randrange(1, 12)))
    rows = [(i, text(), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(700)]
    rows += [(i, text(), rng.choice(["en", "de"]), "a") for i in (3, 3, 5)] + [(None, "w1 w2", "en", "a"), (900, None, "en", "a"), (901, "w1", "en", "a"), (902, "w1", "en", "a")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, page_content string, doc_family string, doc_role string").repartition(5)
    queries = spark.createDataFrame([(i, text()) for i in range(40)] + [(40, "unknown"), (41, None), (None, "w1")], "query_id bigint, question string")
    rules = spark.createDataFrame([(i, ["en", None, "xx"][i % 3], ["a", None][i % 2], i % 4 == 0) for i in range(25)] + [(30, "en", "a", None)], "query_id bigint, family string, role string, by_role boolean")
    scores = lexical.bm25_scores(chunks, queries)
    found = lambda df: sorted((r["query_id"] or -1, r["rank"], r["chunk_id"], round(r["score"], 7)) for r in df.collect())
    for k in (3, 50):
        assert found(lexical.bm25_top_k(chunks, queries, k)) == found(lexical.top_k(scores, k))
        want = found(lexical.top_k(fusion.restrict(scores, chunks, rules), k))
        assert found(lexical.bm25_top_k(chunks, queries, k, rules=rules)) == want and len(want) > 60


def test_queries_of_a_group_meet_its_vectors(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from evidentia.operators import vectors

    rng = np.random.default_rng(9)
    v = [(i, rng.normal(size=4).tolist(), ["a", "b", None][i % 3]) for i in range(2500)] + [(i, None, ["a", "b"][i % 2]) for i in range(2500, 2540)] + [(2540, [1.0], "a"), (2541, [float("nan")] * 4, "b"), (2542, rng.normal(size=4).tolist(), "c")]
    q = [(i, rng.normal(size=4).tolist(), ["a", "b", "c", None, "none"][i % 5]) for i in range(60)] + [(60, None, "a"), (61, None, None), (62, [2.0], "a")]
    p = spark.createDataFrame(v, "chunk_id bigint, vec array<double>, grp string").repartition(4)
    asked = spark.createDataFrame(q, "query_id bigint, vec array<double>, grp string")
    pairs = asked.select("query_id", F.col("vec").alias("q"), F.col("grp").alias("g")).crossJoin(p).where("g is null or g = grp").select("query_id", "chunk_id", vectors.dot(p["vec"], "q").alias("score"))
    rounded = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], repr(r["score"] if r["score"] is None else round(r["score"], 8))) for r in df.collect())
    got = rounded(vectors.vector_top_k(p, asked, 7))
    assert got == rounded(vectors.rank_scored(pairs, 7)) and {r[0] for r in got} == set(range(63)) - set(range(4, 60, 5))
