import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import cli
from evidentia.operators import ask, corpus, fusion, index, keyword_index, layout, lexical, models, packing, quota, vectors
from evidentia.options import Options, writable_folder

DOCS = [(0, "pumps and valves of the plant", "t1", "A", "x"), (1, "valve seats, pumps", "t2", "A", "y"), (2, None, None, "B", "x"), (3, "", "t1", None, None), (4, "the plant plant plant", "t4 pumps", "A", "x")]


def corpus_of(spark):
    return spark.createDataFrame(DOCS, "chunk_id bigint, page_content string, title_text string, doc_family string, doc_role string")


def test_stored_index_scores_like_the_scan(spark, tmp_path):
    docs, path = corpus_of(spark), str(tmp_path / "kw")
    q = spark.createDataFrame([(1, "Pumps of a plant"), (2, "t1"), (3, ""), (4, None), (5, "zebra")], "query_id int, question string")
    stored = keyword_index.ensure(docs, ["page_content", "title_text"], path, "s1")
    for field in ("page_content", "title_text"):
        want = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.bm25_scores(docs, q, field).collect()}
        got = {(r["query_id"], r["chunk_id"]): r["score"] for r in stored.scores(q, field).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want
    assert {r["chunk_id"]: r["dl"] for r in stored.docs.where("field = 'page_content'").collect()} == {0: 8, 1: 5, 2: 0, 3: 0, 4: 4}
    allowed = spark.createDataFrame([(1, 4)], "query_id int, chunk_id bigint")
    assert [r["chunk_id"] for r in stored.top_k(q, 5, allowed=allowed).collect()] == [4]
    keyword_index.ensure(docs.limit(0), ["page_content"], path, "s1")  # signed alike: stays
    assert keyword_index.open_keyword_index(spark, path, "s1").docs.count() == 10
    with pytest.raises(FileNotFoundError):
        keyword_index.open_keyword_index(spark, path, "other")
    empty = keyword_index.ensure(docs.limit(0), ["page_content"], path, "s2")
    assert empty.scores(q).count() == 0
    empty.refresh()


def test_files_are_signed_and_rows_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    first = layout.files_signature(spark, path)
    assert first == layout.files_signature(spark, path) and len(first) == 16
    spark.range(11).write.mode("append").parquet(path)
    assert layout.files_signature(spark, path) != first
    one = spark.range(100).coalesce(1)
    assert layout.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and layout.spread(one).count() == 100
    many = spark.range(100).repartition(64)
    assert layout.spread(many) is many


def brute_route(q, docs, least=3):
    """Chunks that a route admits, or None: one route at a time."""
    family, role = q
    if family is None and role is None:
        return None
    fits = {d[0] for d in docs if family is None or d[3] == family}
    by_role = {i for i in fits if role is not None and next(d for d in docs if d[0] == i)[4] == role}
    fits = by_role if role is not None and len(by_role) >= least else fits
    return fits if len(fits) >= least else None


def test_routes_equal_one_by_one(spark):
    docs = [(i, "t", "h", ["A", "B", None][i % 3], ["x", "y", None, "x"][i % 4]) for i in range(14)]
    asked = {k: r for k, r in enumerate([(f, r) for f in ("A", "B", "Z", None) for r in ("x", "y", "nope", None)])}
    c = spark.createDataFrame(docs, "chunk_id bigint, page_content string, title_text string, doc_family string, doc_role string")
    q = spark.createDataFrame([(k, *r) for k, r in asked.items()], "query_id int, family string, role string")
    got: dict[int, set] = {}
    for r in fusion.allowed_chunks(q, c).collect():
        got.setdefault(r["query_id"], set()).add(r["chunk_id"])
    want = {k: brute_route(r, docs) for k, r in asked.items()}
    assert got == {k: w for k, w in want.items() if w is not None}
    pairs = q.select("query_id").crossJoin(c.select("chunk_id")).withColumn("score", F.lit(1.0))
    kept: dict[int, set] = {}
    for r in fusion.restrict(pairs, c, fusion.routes(q, c)).collect():
        kept.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert kept == {k: {d[0] for d in docs} if w is None else w for k, w in want.items()}


def test_whole_search(spark):
    """The family filters the vector scan before the cut, the role after it; too few hits are replaced; candidates are reranked and cut."""
    rng = np.random.default_rng(1)
    docs = [(i, f"word{i % 5} plant", f"title{i % 4}", "A" if i < 20 else "B", "x" if i % 2 else "y", "", "") for i in range(40)]
    c = spark.createDataFrame([(d[0], d[1], d[3], d[4], "1", d[2]) for d in docs], "chunk_id bigint, page_content string, doc_family string, doc_role string, clause_id string, heading string")
    vec = {i: rng.normal(size=4) for i in range(40)}
    v = spark.createDataFrame([(i, x.tolist()) for i, x in vec.items()], "chunk_id bigint, vec array<double>")
    q = spark.createDataFrame([(1, "word1 plant"), (2, "word2"), (3, "title3 word4")], "query_id int, question string")
    asked = {1: ("A", "x"), 2: ("Z", None), 3: (None, "y")}
    qv = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in asked], "query_id int, vec array<double>")
    qvec = {r["query_id"]: np.array(r["vec"]) for r in qv.collect()}
    k = 8
    routed = spark.createDataFrame([(i, *r) for i, r in asked.items()], "query_id int, family string, role string")
    fused = fusion.hybrid_search(c, q, v, qv, k=k, routed=routed).collect()
    body = {r: s for r, s in (((x["query_id"], x["chunk_id"]), x["score"]) for x in lexical.bm25_scores(c, q).collect())}
    title = {r: s for r, s in (((x["query_id"], x["chunk_id"]), x["score"]) for x in lexical.bm25_scores(lexical.title_field(c), q, "title_text").collect())}
    for i, (family, role) in asked.items():
        allowed = brute_route((family, role), [(d[0], 0, 0, d[3], d[4]) for d in docs])
        order = sorted(vec, key=lambda j: (-round(float(vec[j] @ qvec[i]), 9), j))
        near = [j for j in order if family is None or docs[j][3] == family][:k]
        near = [j for j in near if allowed is None or j in allowed]
        near = near if len(near) >= 3 else order[:k]
        lists = [near] + [sorted((j for (a, j) in s if a == i and (allowed is None or j in allowed)), key=lambda j, s=s: (-round(s[i, j], 9), j))[:k] for s in (body, title)]
        points: dict[int, float] = {}
        for one in lists:
            for rank, j in enumerate(one, 1):
                points[j] = points.get(j, 0) + 1 / (60 + rank)
        met = list(dict.fromkeys(j for one in lists for j in one))
        want = sorted(points, key=lambda j: (-round(points[j], 12), met.index(j)))
        got = [r["chunk_id"] for r in sorted((r for r in fused if r["query_id"] == i), key=lambda r: r["rank"])]
        assert got == want, i
    score = lambda pairs: pairs.select("query_id", "chunk_id", F.col("chunk_id").cast("double").alias("score"))
    cross = fusion.search(c, q, v, qv, score, limit=3, k=k, routed=routed).collect()
    late = fusion.search(c, q, v, qv, score, strategy="late-interaction", k=k, routed=routed).collect()
    for i in asked:
        every = [r["chunk_id"] for r in fused if r["query_id"] == i]
        assert [r["chunk_id"] for r in sorted((r for r in cross if r["query_id"] == i), key=lambda r: r["rank"])] == sorted(every, reverse=True)[:3]
        assert [r["chunk_id"] for r in sorted((r for r in late if r["query_id"] == i), key=lambda r: r["rank"])] == sorted(every, reverse=True)[:20]
    inferred = fusion.inferred_routes(spark.createDataFrame([(1, "design of S-737")], "query_id int, question string")).first()
    assert (inferred["family"], inferred["role"]) == ("S-737", "TRS")


def test_vector_queries_go_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "chunk_id int, vec array<double>")
    q = spark.createDataFrame([(i, [1.0, -float(i)]) for i in range(9)], "query_id int, vec array<double>")
    whole = sorted(map(tuple, vectors.vector_top_k(v, q, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, vectors.vector_top_k(v, q, 3).collect())) == whole and len(whole) == 27
    assert vectors.vector_top_k(v, q.limit(0), 3).count() == 0


def test_cross_rerank_and_token_vectors(spark):
    fused = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, chunk_id int, rank int")
    q = spark.createDataFrame([(1, "abc")], "query_id int, question string")
    c = spark.createDataFrame([(10, "x"), (11, "xxxx"), (12, "xxxx")], "chunk_id int, page_content string")
    scorer = models.pair_scorer(lambda: lambda pairs: np.array([float(len(p)) for _, p in pairs]))
    assert [(r["chunk_id"], r["rank"]) for r in models.cross_rerank(fused, q, c, scorer, limit=2).orderBy("rank").collect()] == [(11, 1), (12, 2)]
    tokens = models.token_vectors(lambda: lambda texts: [np.array([[3.0, 4.0]] * max(len(t), 1)) for t in texts])
    got = spark.createDataFrame([("ab",), (None,)], "t string").select(tokens(F.col("t")).alias("v")).collect()
    assert [len(r["v"]) for r in got] == [2, 1] and np.allclose(got[0]["v"][0], [0.6, 0.8])


def test_instances_are_made_once():
    made = []
    load = lambda: made.append(1) or len(made)
    assert models.once(load, "test-instance") == models.once(load, "test-instance") == 1 and models.once(load) == 2


def test_model_files(tmp_path):
    (tmp_path / "m.onnx").write_bytes(b"x")
    assert models.model_file(str(tmp_path), "m.onnx").endswith("m.onnx")
    with pytest.raises(FileNotFoundError):
        models.model_file(str(tmp_path), "none.onnx")
    public = pytest.importorskip("public_tokenizers")
    plain = models.open_tokenizer(public.path("word_bpe_49k.json"), None)
    short = models.open_tokenizer(public.path("word_bpe_49k.json"), 4)
    texts = ["one", "one two three four five six seven"]
    assert [len(e.ids) for e in short.encode_batch(texts)] == [4, 4] and len(plain.encode(texts[1], add_special_tokens=False).ids) == 7


def test_provider_models():
    def fails():
        raise OSError("no network")

    assert models.available_models(lambda: ["b", "a"]) == ["a", "b"] and models.available_models(fails) == []
    assert models.validate_models(["a", " z "], lambda: ["a"]) == (["z"], ["a"]) and models.validate_models(["z"], fails, strict=True) == ([], [])
    with pytest.raises(RuntimeError, match="z"):
        models.validate_models(["z"], lambda: ["a"], strict=True)
    makers = {"p": lambda model, temperature: (model, temperature), "": lambda model, temperature: "other"}
    assert models.chat_model("p", "m", makers) == ("m", 0.0) and models.chat_model("q", "m", makers) == "other"
    with pytest.raises(RuntimeError):
        models.chat_model("q", "m", {})


def test_messages(spark):
    got = spark.createDataFrame([("ctx", "why?"), (None, None)], "c string, q string").select(models.messages(F.col("c"), F.col("q")).alias("m")).collect()
    assert [(x["role"], x["content"][-4:]) for x in got[0]["m"]] == [("system", "\nctx"), ("user", "why?")] and got[1]["m"][1]["content"] == ""


def test_options():
    assert Options.from_env({}) == Options()
    env = {"EVIDENTIA_ANSWERS_PER_DAY": "9", "EVIDENTIA_MIN_SECONDS": "", "EVIDENTIA_QUOTA_GUARD": " Off ", "EVIDENTIA_FALLBACK_MODELS": "a, ,b", "EVIDENTIA_RERANK": " ON", "OTHER": "1"}
    got = Options.from_env(env)
    assert (got.answers_per_day, got.min_seconds, got.quota_guard, got.fallback_models, got.rerank) == (9, 4.0, False, ("a", "b"), "on")


def test_writable_folder(tmp_path):
    assert writable_folder(str(tmp_path / "x")) == str(tmp_path / "x") and list(tmp_path.iterdir()) == []
    (tmp_path / "file").write_text("x")
    assert writable_folder(str(tmp_path / "file" / "y")).endswith("evidentia")


def test_token_counters(spark):
    df = spark.createDataFrame([("one two three",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(packing.token_counts(F.col("t"))).collect()] == [3, 0, 0]
    public = pytest.importorskip("public_tokenizers")
    load = packing.tokenizer_counter(public.path("word_bpe_49k.json"))
    text = " ".join(["unbelievable"] * 900)
    from tokenizers import Tokenizer

    n = len(Tokenizer.from_file(public.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert [r[0] for r in spark.createDataFrame([(text,)], "t string").select(packing.token_counts(F.col("t"), load)).collect()] == [n] and n > 512


def test_long_lines_are_cut_between_words(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b",), ("x" * 50,), (None,), (" a  b ",)], "t string")
    assert [r[0] for r in df.select(packing.split_long_line(F.col("t"), 2)).collect()] == [["a b", "c d", "e"], ["a b"], ["x" * 50], None, [" a  b "]]
    assert packing.fold([(1, "a", 2), (1, "b", 2), (2, "c", 1), (2, "d", 9)], 4) == [(1, ["a", "b"]), (2, ["c"]), (2, ["d"])]


def test_build_gives_its_statistics(spark, tmp_path):
    pages = spark.createDataFrame([("a.md", 1, "4.1 Storage of parts\n" + "word " * 60), ("a.md", 2, "more " * 40), ("b.md", 1, "other text " * 30)], "source_file string, page int, text string")
    path = str(tmp_path / "ix")
    got = index.build_with_stats(pages, path, "s", window=64)
    stored = index.open_index(spark, path, "s")
    sizes = sorted(r["tokens"] for r in stored.collect())
    assert got == {"chunks": len(sizes), "least": sizes[0], "median": sizes[len(sizes) // 2], "most": sizes[-1], "over": 0, "documents": 2, "pages": 3}
    index.refresh(spark, path, stored)
    index.refresh(spark, str(tmp_path / "nowhere"))


def test_conversation_is_cleared_when_confirmed(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (None, 0, "user", "c")], "conv_id bigint, turn int, role string, text string")
    assert corpus.clear_conversation(turns, 1).count() == 3 and corpus.clear_conversation(turns, 1, confirmed=True).count() == 2


def test_about_the_assistant(spark):
    chunks = spark.createDataFrame([("a.md",), ("b.md",), ("",)], "source_file string")
    text = corpus.capability_answer(chunks, {"a.md": "Alpha"}, ["Card"], {"Kind": ["q1", "q2"]}).first()["answer"]
    assert text.startswith("These files can be searched: Alpha, b.md.\n\nSubjects:\n- Card\n") and "- Kind: q1; q2" in text and text.endswith(corpus.CLOSING)


def test_sessions_are_not_gathered(spark):
    rows = [(s, i, i * 3 if s == 1 else i * 10) for i in range(300) for s in (1, 2)] + [(None, 999, 5), (3, 1000, None), (3, 1001, None)]
    df = spark.createDataFrame(rows, "session bigint, event_id bigint, s bigint").select("session", "event_id", F.timestamp_seconds("s").alias("ts"))
    got = {(r["session"], r["event_id"]): (r["ok"], r["reason"], r["used"]) for r in quota.admit_by_session(df, per_session=3, gap=10).collect()}
    assert got[1, 0] == (True, "", 1) and got[1, 1] == (False, "gap", 1) and got[1, 4] == (True, "", 2) and got[1, 8] == (True, "", 3) and got[1, 9] == (False, "session", 3)
    assert got[2, 1] == (True, "", 2) and got[None, 999] == (True, "", 1) and got[3, 1000][0] and got[3, 1001][0] and len(got) == len(rows)


def asked_model(first, second):
    """A model that answers by how many excerpts it is shown: `first` for 12, `second` for any other number."""

    def load():
        def call(model, context, question):
            n = context.count("<untrusted_source>")
            claim = {"text": f"seen {n}", "clause_id": "1", "source_file": "d0", "page": 1, "quote": "alpha beta gamma delta epsilon zeta"}
            kind = first if n == 12 else second
            claims = {"good": [claim], "bad": [claim | {"quote": "not at all written in any of these"}], "none": []}[kind]
            return json.dumps({"claims": claims, "not_found": not claims})

        return call

    return load


@pytest.mark.parametrize(("first", "second", "answer", "retried"), [("bad", "good", "seen 24 (", True), ("none", "good", "seen 6 (", True), ("good", "none", "seen 12 (", False), ("bad", "none", "This information", False), ("none", "bad", "This information", False)])
def test_second_attempt(spark, first, second, answer, retried):
    chunks = spark.createDataFrame([(i, f"d{i}", 1, "1", "alpha beta gamma delta epsilon zeta eta") for i in range(30)], "chunk_id int, source_file string, page int, clause_id string, page_content string")
    ranking = spark.createDataFrame([(7, i, i + 1) for i in range(30)], "query_id int, chunk_id int, rank int")
    q = spark.createDataFrame([(7, "what stands there")], "query_id int, question string")
    row = ask.ask(q, ranking, chunks, ["m"], asked_model(first, second)).first()
    assert row["answer"].startswith(answer) and row["retried"] == retried
    assert row["n_rejected"] == (1 if first == "bad" and not retried else 0)
    shown = 12 if not retried else int(answer.split()[1])
    assert row["sources"] == sorted(f"d{i}" for i in range(shown)) and row["clauses"] == ["1"]


def test_evaluation_command(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("4.1 Storage of parts\nParts are stored in dry rooms with closed doors and shelves.\n<!-- page -->\n4.2 Labels of shelves\nEach shelf has a label that names its contents and the owner.")
    (tmp_path / "docs" / "b.md").write_text("5.1 Transport by road\nLorries wait at the gate until the guard opens it for them.")
    golden = tmp_path / "g.yaml"
    golden.write_text("questions:\n  - {id: q1, lang: en, question: where are parts stored, expected_file: a.md, expected_pages: [1]}\n  - {id: q2, lang: en, question: what do lorries do, expected_file: a.md, also_accept: [{file: b.md}]}\n  - {id: q3, lang: en, question: zebra, expected_file: b.md}\n")
    out = tmp_path / "rows.json"
    cli.main(["evaluate", "--docs", str(tmp_path / "docs"), "--golden", str(golden), "--json", str(out)], spark)
    text = capsys.readouterr().out
    assert "questions              3" in text and "MISS q3" in text and "OK   q1" in text
    rows = json.loads(out.read_text())
    assert [(r["id"], r["doc_hit"], r["page_hit"]) for r in rows] == [("q1", True, True), ("q2", True, True), ("q3", False, False)] and rows[0]["retrieved"][0] == {"file": "a.md", "page": 1}


def test_evaluation_of_the_whole_search(spark, tmp_path, capsys):
    """With an encoder all three lists count, and a scorer has the last word."""
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("4.1 Storage of parts\nParts are stored in dry rooms with closed doors and shelves.\n<!-- page -->\n4.2 Labels of shelves\nEach shelf has a label that names its contents and the owner.")
    (tmp_path / "docs" / "b.md").write_text("5.1 Transport by road\nLorries wait at the gate until the guard opens it for them.")
    golden = tmp_path / "g.yaml"
    golden.write_text("questions:\n  - {id: q1, lang: en, question: parts are stored in dry rooms, expected_file: a.md, expected_pages: [1]}\n  - {id: q2, lang: en, question: zebra, expected_file: b.md}\n")
    out = tmp_path / "rows.json"
    for more in ([], ["--scorer", "tests.stand_ins:scorer"]):
        cli.main(["evaluate", "--docs", str(tmp_path / "docs"), "--golden", str(golden), "--encoder", "tests.stand_ins:encoder", *more, "--json", str(out)], spark)
        rows = {r["id"]: r for r in json.loads(out.read_text())}
        assert "questions              2" in capsys.readouterr().out
        assert rows["q1"]["page_hit"] and len(rows["q1"]["retrieved"]) == 3 and len(rows["q2"]["retrieved"]) == 3  # vectors rank what shares no word
        assert not more or rows["q1"]["retrieved"][0] == {"file": "a.md", "page": 1}


def test_report_and_container(spark, tmp_path):
    from evidentia.sources import files

    files.write_report(spark.createDataFrame([(1, "a")], "n int, t string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["t"] == "a"
    assert not files.inside_container(str(tmp_path / "none")) and files.inside_container(str(tmp_path))
