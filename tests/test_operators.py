import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import ask, corpus, evaluate, evidence, fusion, index, lexical, models, packing, quota, structure, vectors
from evidentia.sources import files
from evidentia.streaming import admission


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source_file string, page int, text string")


def segments(spark, *rows):
    return [r.asDict() for r in structure.segment(pages_of(spark, *rows)).orderBy("source_file", "seq").collect()]


def test_running_headers_go_and_bodies_stay(spark):
    got = structure.strip_running_headers(pages_of(spark, *[("a", i, f"Header\nbody {i}\n\nPage {i} of 5") for i in range(1, 6)])).orderBy("page").collect()
    assert [r["text"] for r in got] == [f"body {i}" for i in range(1, 6)]


def test_no_clause_mixes_documents(spark):
    got = segments(spark, ("A.md", 1, "front\n7.2 Welding\nx"), ("A.md", 2, "y"), ("B.md", 1, "own front"), ("B.md", 2, "7.2.1\nz"))
    assert [(g["source_file"], g["clause_id"], g["title"]) for g in got] == [("A.md", "", "(preamble)"), ("A.md", "7.2", "Welding"), ("B.md", "", "(preamble)")]
    assert [x["line"] for x in got[2]["lines"]] == ["own front", "7.2.1", "z"]


def test_bare_numbers_need_an_ancestor_and_take_its_title(spark):
    got = segments(spark, ("a", 1, "5.3 Spare parts of pumps\nbody\n5.3.7\nmore\n2024.365\nrest"))
    assert [(g["clause_id"], g["title"], g["parent_title"]) for g in got] == [("5.3", "Spare parts of pumps", ""), ("5.3.7", "", "Spare parts of pumps")]
    assert got[1]["section"] == "5.3" and [x["line"] for x in got[1]["lines"]] == ["more", "2024.365", "rest"]


def test_contents_pages_are_left_out(spark):
    assert segments(spark, ("a", 1, "Contents\nForeword ....... 4\nScope ....... 5\nTests ....... 6")) == []


def test_heading_styles(spark):
    lines = ["9.4 Drying of coats", "3. Rules of the workshop", "Part B - Records and their keeping", "Definitions:", "365 Days of something", "| 9.4 Table", "a sentence"]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(structure.heading(F.col("l")).alias("h"))
    got = [r["h"] and (r["h"]["clause_id"], r["h"]["title"]) for r in df.collect()]
    assert got == [("9.4", "Drying of coats"), ("3", "Rules of the workshop"), ("Part B", "Records and their keeping"), ("", "Definitions"), None, None, None]


def test_chunks_stay_on_a_page_and_in_budget(spark):
    one = "4.1 Pumps and skids\n" + "\n".join("word " * 10 for _ in range(4))
    seg = structure.segment(pages_of(spark, ("a", 1, one), ("a", 2, "\n".join("other " * 10 for _ in range(4)))))
    got = packing.pack(seg, 60).collect()
    assert {r["page"] for r in got} == {1, 2}
    assert not any("word" in r["page_content"] and "other" in r["page_content"] for r in got)
    long = packing.pack(structure.segment(pages_of(spark, ("a", 1, "4.1 Pumps and skids\n" + "w " * 300))), 100).collect()
    assert len(long) > 2 and all(len(r["page_content"].split()) <= 100 for r in long)
    assert sum(r["page_content"].split().count("w") for r in long) == 300


def test_model_window():
    assert packing.model_window({"max_seq_length": 128}) == 128 and packing.model_window({"model_max_length": 10**30}) == 512 and packing.model_window({}) == 512


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "pressure test of each skid"), (1, "protective coating shall apply"), (2, "noise limits"), (3, None)], "chunk_id bigint, page_content string")
    q = spark.createDataFrame([(1, "protective coatings"), (2, "zebra"), (3, "pressure"), (4, "")], "query_id int, question string")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in lexical.bm25_top_k(docs, q, 3).collect()}
    assert got == {(1, 1): 1, (3, 1): 0}
    allowed = spark.createDataFrame([(3, 1)], "query_id int, chunk_id bigint")
    assert lexical.bm25_top_k(docs, q, 3, allowed).count() == 0
    assert lexical.bm25_top_k(docs.limit(0), q, 3).count() == 0


def test_rank_fusion(spark):
    r = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "c", 3), (1, 1, "c", 1), (1, 1, "a", 2)], "query_id int, source_ord int, chunk_id string, rank int")
    assert [x["chunk_id"] for x in fusion.rrf(r).orderBy("rank").collect()] == ["a", "c", "b"]


def test_routes(spark):
    q = spark.createDataFrame([("is s 812 newer than S-813?",), ("lifesaving gear",), ("Tier 2 counts",), ("sound pressure at night",), ("water mist near a deluge",), ("who is the author",), (None,)], "q string")
    assert [r[0] for r in q.select(fusion.infer_family(F.col("q"), strict=True)).collect()] == ["S-812", "459", "456", "S-717", "S-737", None, None]
    roles = spark.createDataFrame([("conformity of a weld",), ("fabrication and inspection",), ("when",)], "q string")
    assert [r[0] for r in roles.select(fusion.infer_role(F.col("q"))).collect()] == ["QRS", "TRS", None]


def test_too_narrow_routes_are_no_routes(spark):
    c = spark.createDataFrame([(i, "S-1" if i < 5 else "S-2", "TRS" if i < 2 else "QRS") for i in range(7)], "chunk_id int, doc_family string, doc_role string")
    q = spark.createDataFrame([(1, "S-1", "TRS"), (2, "S-2", None), (3, "S-1", "QRS")], "query_id int, family string, role string")
    got = fusion.allowed_chunks(q, c).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 5, 3: 3}
    cands = c.crossJoin(q.select("query_id"))
    assert {r["query_id"]: r["count"] for r in fusion.apply_route(cands, q).groupBy("query_id").count().collect()} == {1: 5, 2: 7, 3: 3}


def test_rerank_strategy():
    s = fusion.rerank_strategy
    assert [s(limit_mb=690), s(limit_mb=1400), s(limit_mb=2700), s(), s(in_container=True), s("on", 1), s("off")] == ["late-interaction", "cross-encoder", "cross-encoder", "cross-encoder", "late-interaction", "cross-encoder", "late-interaction"]


EXCERPTS = [(1, 1, "a.md", 3, "3.1", "3.1 Access\nThe purchaser shall be given access to the works at any time.\n3.2.1 Each skid shall be tested at high pressure for thirty minutes")]


def test_claims(spark):
    ex = spark.createDataFrame(EXCERPTS, "query_id int, rank int, source_file string, page int, clause_id string, page_content string")
    quote = "Each skid shall be tested at high pressure"
    rows = [(1, 0, "t", "3.1", "a.md", 9, quote), (1, 1, "t", "3.1", "a.md", 3, "words that were never written in any place"), (1, 2, "t", "3.1", "a.md", 3, quote), (1, 3, "t", "3.2.1", "a.md", 3, quote), (1, 4, "t", "9.9", "a.md", 3, quote)]
    claims = spark.createDataFrame(rows, "query_id int, pos int, text string, clause_id string, source_file string, page int, quote string")
    got = {r["pos"]: r["reason"] for r in evidence.verify(claims, ex).collect()}
    assert got == {0: evidence.NOT_RETRIEVED, 1: evidence.NOT_QUOTED, 2: None, 3: None, 4: evidence.NOT_RETRIEVED}


def test_same_key_strict_or_any(spark):
    ex = spark.createDataFrame([(1, 1, "a", 1, "1", "the quick brown fox jumps over it"), (1, 2, "a", 1, "1", "nothing")], "query_id int, rank int, source_file string, page int, clause_id string, page_content string")
    c = spark.createDataFrame([(1, 0, "t", "1", "a", 1, "the quick brown fox jumps over")], "query_id int, pos int, text string, clause_id string, source_file string, page int, quote string")
    assert evidence.verify(c, ex).first()["accepted"] and not evidence.verify(c, ex, strict=True).first()["accepted"]


def test_quota(spark):
    gate = quota.Gate(per_session=2, per_day=3, gap=10)
    assert gate("a", 0)[:2] == (True, "")
    assert gate("a", 3)[1:] == ("gap", 2, 7.0)
    assert gate("a", 20)[0] and gate("a", 40)[1] == "session"
    assert gate("b", 41)[0] and gate("c", 42)[1] == "daily" and gate("c", 86400)[0]


def test_batch_and_stream_admit_alike(spark, tmp_path):
    rows = [(i * i % 7, i, i * 611 if i % 3 else i * 611 - 600) for i in range(1200)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, s bigint").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "ev.parquet")
    df.coalesce(1).write.parquet(path)
    caps = {"per_session": 50, "per_day": 25, "gap": 1900.0}
    a = {r["event_id"]: (r["ok"], r["reason"]) for r in quota.admit(df.withColumnRenamed("user_id", "session"), **caps).collect()}
    b = {r["event_id"]: (r["ok"], r["reason"]) for r in admission.admit_stream_once(spark, path, **caps).collect()}
    gate = quota.Gate(**caps)
    assert a == b == {i: gate(u, s)[:2] for u, i, s in rows}
    assert {v[1] for v in a.values()} == {"", "gap", "daily", "session"}


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "ix")
    df = spark.createDataFrame([(1, "x")], "chunk_id int, doc_family string")
    sign = index.signature_of(spark, "a", "b")
    assert len(sign) == 16 and not index.is_valid(spark, path, sign)
    assert index.ensure(df, path, sign) and not index.ensure(df, path, sign)
    assert not index.is_valid(spark, path, "other") and index.open_index(spark, path, sign).count() == 1
    index.build(df.limit(0), path, sign)
    assert not index.is_valid(spark, path, sign)


def test_files(spark, tmp_path):
    (tmp_path / "b note.MD").write_text("first page is long enough\n<!-- page -->\nshort\n <!-- PAGE --> \nthird page is long enough", encoding="utf-8")
    (tmp_path / "a.txt").write_text("only page of this text file")
    (tmp_path / "skip.csv").write_text("x" * 50)
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = files.load_pages(spark, str(tmp_path), pdf=lambda b: [(1, "a page from a pdf file")]).orderBy("source_file", "page").collect()
    assert [(r["source_file"], r["page"]) for r in got] == [("a.txt", 1), ("b note.MD", 1), ("b note.MD", 3), ("c.pdf", 1)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "empty"))
    assert files.select_folder(None, str(tmp_path / "empty"), "s") == ("s", "sample") and files.select_folder(None, str(tmp_path), "s")[1] == "documents"


def test_tables_as_markdown(spark):
    df = spark.sql("SELECT array(array('a', NULL), array('b\nc', 'd')) AS t")
    assert df.select(files.table_to_markdown(F.col("t"))).first()[0] == "| a |  |\n| --- | --- |\n| b c | d |"


def test_quota_state_file(tmp_path):
    p = str(tmp_path / "q" / "state.json")
    assert files.read_used(p, "2024-01-01") == 0
    files.write_used(p, "2024-01-01", 3)
    assert files.read_used(p, "2024-01-01") == 3 and files.read_used(p, "2024-01-02") == 0
    (tmp_path / "q" / "state.json").write_text("{broken")
    assert files.read_used(p, "2024-01-01") == 0


@pytest.mark.parametrize(("text", "want"), [("max", None), ("724828160", 691), ("9223372036854771712", None), ("abc", None), (None, None)])
def test_memory_limit(tmp_path, text, want):
    p = tmp_path / "m"
    if text is not None:
        p.write_text(text)
    assert files.memory_limit_mb((str(p),)) == want


def test_evaluation(spark):
    got = spark.createDataFrame([("q", 1, "x", 1), ("q", 2, "a", 9), ("q", 3, "b", 2)], "id string, rank int, file string, page int")
    gold = spark.createDataFrame([("q", [("a", [1]), ("b", [2])]), ("r", [("a", [])])], "id string, accepted array<struct<file:string,pages:array<int>>>")
    judged = {r["id"]: (r["doc_rank"], r["page_rank"]) for r in evaluate.judge(got, gold).collect()}
    assert judged == {"q": (2, 3), "r": (None, None)}


def fake_encoder():
    return lambda texts: [np.array([[len(t), 1.0], [1.0, 0.0]]) for t in texts]


def test_models(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,), ("abcd",)], "t string")
    got = models.embed_distinct(df, "t", models.embedder(fake_encoder)).collect()
    assert len(got) == 4 and all(r["vec"] is None or abs(np.linalg.norm(r["vec"]) - 1) < 1e-6 for r in got)
    score = models.pair_scorer(lambda: lambda pairs: np.array([[0.0, len(q) + len(p)] for q, p in pairs]))
    assert [r[0] for r in df.select(score(F.col("t"), F.lit("x"))).collect()] == [3.0, 3.0, 1.0, 5.0]


def test_fallback():
    def call(m):
        if m == "a":
            raise RuntimeError("429 rate_limit")
        if m == "c":
            raise ValueError("bad request")
        return m

    assert models.with_fallback(["a", " b "], call) == "b"
    with pytest.raises(ValueError):
        models.with_fallback(["a", "c", "b"], call)
    with pytest.raises(RuntimeError, match="all models failed"):
        models.with_fallback(["a"], call)


def test_missing_models(spark):
    have = spark.createDataFrame([("a",)], "model string")
    assert [r[0] for r in corpus.missing_models(["a", " b"], have).collect()] == ["b"] and corpus.missing_models([], have).count() == 0


SPEC = """2 Quality requirements
2.1 Certificates of tests
2.1.1
A test certificate shall be provided for each component that contains pressure, and it shall name the heat number of the material used.
2.1.2
Welding procedures shall be qualified before the start of fabrication and the records shall be kept for the life of the installed skid."""


def make_model():
    import json
    import re

    def call(model, context, question):
        head = re.search(r"Source: (\S+) \| Clause: (\S+) \| Page: (\d+)", context)
        body = context.split("<untrusted_source>\n")[1].split("\n</")[0].split("\n")[1]
        good = {"text": "It says so.", "clause_id": head[2], "source_file": head[1], "page": int(head[3]), "quote": body}
        return json.dumps({"claims": [good, good | {"quote": "never said in any of the documents here"}], "not_found": False})

    return call


def test_question_to_answer(spark):
    chunks = packing.build_chunks(pages_of(spark, ("spec.md", 1, SPEC)))
    q = spark.createDataFrame([(1, "Which certificate is needed for tests?"), (2, "What can you do?")], "query_id int, question string")
    ranking = lexical.bm25_top_k(chunks, q, 50)
    got = {r["query_id"]: r for r in ask.ask(q, ranking, chunks, ["m"], make_model, capability="I answer questions.").collect()}
    assert got[1]["answer"] == "It says so. (Source: spec.md, Page: 1)" and got[1]["n_rejected"] == 1 and not got[1]["not_found"]
    assert got[2]["answer"] == "I answer questions."


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "chunk_id int, vec array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vec array<float>")
    assert [r["chunk_id"] for r in vectors.vector_top_k(v, q, 2).orderBy("rank").collect()] == [1, 3]
