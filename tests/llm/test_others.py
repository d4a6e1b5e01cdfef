import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, packing, sharding, toxicity, urls, warc
from evidentia.llm._scratch import Scratch

tokenizers = pytest.importorskip("tokenizers")


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/\r\nx", "<p>é\r\n\r\nsame</p>", 5), (2, None, "<p>é\r\n\r\nsame</p>", 5), (3, "u", None, 5), (4, "u", "", 5), (None, "u", "<p>é\r\n\r\nsame</p>", 5), (5, "u", "x" * 100_000, 5), (5, "u", "x" * 100_000, 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, address int")
    archive = warc.write_archive(pages, Scratch(spark, "t"))
    records = warc.reconstruct(archive)
    got = sorted(map(tuple, warc.resolve_revisits(warc.read_records(records), Scratch(spark, "t")).collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        top = max((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None))
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, warc.resolve_revisits(warc.read_archive(archive), Scratch(spark, "t")).collect()), key=str) == got
    assert archive.objects.count() == 3
    warc.export_files(archive, str(tmp_path / "w"))
    back = sorted(map(tuple, warc.read_files(spark, str(tmp_path / "w")).collect()), key=str)
    assert [(i, bytes(r)) for i, r in back] == [(i, bytes(r)) for i, r in sorted(map(tuple, records.collect()), key=str)]
    empty = warc.write_archive(pages.where(F.lit(False)), Scratch(spark, "t"))
    assert warc.read_records(warc.reconstruct(empty)).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.write_archive(pages, Scratch(spark, "t"), least=4).records.collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def check_pieces(rows, texts, capacity):
    tok = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, t in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(t)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(len(t) for t in ids.values()) / (capacity * len(by_seq))


@pytest.mark.parametrize("capacity", [16, 256])
def test_packing(spark, capacity):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["the", "Skid's", "ünïcode", "12.5", "x" * 30, "\u00a0a", "<|endoftext|>", "!!"]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for i in range(200)}
    texts[5], texts[6] = None, "\u3000 \n"
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, length string")
    share = check_pieces(packing.pack(df.coalesce(1), tokenizer=packing.default_tokenizer(), capacity=capacity).collect(), texts, capacity)
    assert share > 0.97
    check_pieces(packing.pack(df.repartition(3), tokenizer=packing.default_tokenizer(), capacity=capacity).collect(), texts, capacity)
    assert packing.pack(df.where(F.lit(False)), tokenizer=packing.default_tokenizer()).count() == 0


def test_shards(spark):
    rows = [(i if i % 50 else None, f"t{i % 7}" if i % 5 else None, 1) for i in range(1000)] + [(3, "same", 1)] * 30
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.shards(df, 24).collect()
    assert len(got) == 1030 and {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 5} == {(8, 0)}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and {len(s) for s in by.values()} == {42, 43} and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shards(df.where(F.lit(False)), 24).count() == 0
    small = sharding.shards(df.limit(3), 24)
    assert small.select("shard").distinct().count() == 3


def test_matrix_follows_the_law():
    draws = np.array([sharding.matrix([30, 20, 10], [20, 20, 20], seed) for seed in range(2000)])
    assert (draws.sum(1) == 20).all() and (draws.sum(2) == [30, 20, 10]).all()
    assert np.allclose(draws.mean(0), np.outer([30, 20, 10], [20, 20, 20]) / 60, atol=0.15)
    var = 20 * 0.5 * 0.5 * 40 / 59
    assert abs(draws[:, 0, 0].var() - var) < 0.5
    rng = np.random.default_rng(0)
    big = [sharding.draw(rng, 10**12, 3 * 10**12, 10**6) for _ in range(400)]
    assert abs(np.mean(big) - 250_000) < 100 and 300 < np.std(big) < 570


def verdict(url):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(r), r, a) for a, r in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_urls(spark):
    rng = random.Random(6)
    cases = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "http://example.org?x=/es/", "http://a.example.org/en/123#y", "http://badexample.org/es/x", "http://org", "http://org/", "ftp://x.com/fr/9", "http://x.com/de/1?a=b&c=d", "http://é.org/%C3", "a://b://c.org/d", "http://x.net/p"]
    cases += [f"http://{rng.choice(['a', 'b.c', 'spam-win'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(3000)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*cases, *cases[:5]])), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("score", F.lit(1))
    for r in urls.url_verdicts(df, urls.RULES).collect():
        host, path, rule, action = verdict(cases[r["page_id"] % len(cases)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == action if action else r["verdict"] in ("allow", "block")
        assert 0 <= r["score"] <= 1
    assert urls.url_verdicts(df.where(F.lit(False)), urls.RULES).count() == 0


def test_urls_learn_from_labels(spark):
    rows = [(i, f"http://{'win' * 3}{i}.example.net/{'x=' * 9}?a=1&b=2&c={i}" if i % 2 else f"http://news.example.net/{i % 9}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    known = df.where("page_id < 300").select("url", (F.col("page_id") % 2).alias("label"))
    got = urls.url_verdicts(df, [], labels=known).where("page_id >= 300").collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) > 95
    assert {r["verdict"] for r in urls.url_verdicts(df, [("allow", "net/")]).collect()} == {"allow"}


def test_url_suffixes_count_beyond_the_rows_fitted(spark):
    rng = random.Random(12)
    suffixes = sorted({"".join(rng.choice("abcdefghijklm") for _ in range(3)) for _ in range(300)})
    bad = {s: rng.random() < 0.5 for s in suffixes}
    known = spark.createDataFrame([(f"http://host.{s}/{rng.randrange(10**6, 10**7)}", int(bad[s])) for s in suffixes for _ in range(10)], "url string, label int")
    df = spark.createDataFrame([(i, f"http://host.{s}/{rng.randrange(10**6, 10**7)}") for i, s in enumerate(suffixes)], "page_id bigint, url string")
    got = urls.url_verdicts(df, [], most=300, labels=known).collect()
    right = sum((r["verdict"] == "block") == bad[suffixes[r["page_id"]]] for r in got) / len(got)
    assert right > 0.97, right


def test_toxicity_learns_a_pair(spark):
    """An insult counts only beside a group: no sum of single weights can tell."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"filler{rng.randrange(50)}" for _ in range(12)] + ["insultish"] * a + ["groupish"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a == b)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("score", F.lit("clash"))
    machine = toxicity.train(df, df.where("doc_id < 2000").select("doc_id", "toxic"), rounds=40, rate=0.2)
    got = toxicity.score(df.where("doc_id >= 2000"), machine).collect()
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) / len(got) > 0.95


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "x " * 50_000), (1, None)], "doc_id bigint, text string")
    none = toxicity.train(df, df.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(df, none).collect())
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(df.where(F.lit(False)), none).count() == 0
    flags = df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flags)


def edits(text, n, rng):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(i, rng.choice("abcdefgh"))
        else:
            del out[i]
    return "".join(out)


def distance_in(pattern, text):
    """Least edit distance of pattern to a substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_search_is_exact():
    rng = random.Random(3)
    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 70))).encode()
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))).encode()
        assert decontaminate.edit_search(decontaminate._masks(p), len(p), t)[0] == distance_in(p, t)


def test_leaks_are_found(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(12, 50)).capitalize() + ".") for i in range(40)] + [(100, None), (101, ""), (102, "too short"), (None, prose(20))]
    docs, truth = [], {}
    for i in range(300):
        body = prose(80)
        if i % 3 == 0:
            item = items[i % 40]
            rate = (0, 0.02, 0.05, 0.1)[i // 3 % 4]
            body = prose(30) + ",\n" + edits(item[1].upper() if rate == 0 else item[1], int(rate * len(item[1])), rng) + " " + prose(30)
            truth[i] = (item[0], rate)
        docs.append((i, body, "x"))
    docs += [(400, None, "x"), (401, "", "x"), (None, items[3][1], "x"), (402, items[3][1] * 2, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, distance string")
    got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    found = {rate: [(d, i) in pairs for d, (i, r) in truth.items() if r == rate] for rate in (0, 0.02, 0.05, 0.1)}
    share = {k: sum(v) / len(v) for k, v in found.items()}
    assert share[0] == 1 and share[0.02] >= 0.95 and share[0.05] >= 0.9 and share[0.1] >= 0.7, share
    assert {d for d, _ in pairs} <= {*truth, 402, None}
    texts = {d: t for d, t, _ in docs}
    for r in got:
        if r["doc_id"] in truth and truth[r["doc_id"]][1] == 0:
            part = texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode()
            assert part.lower().rstrip(".") == dict(items)[r["item_id"]].lower().rstrip(".") and r["distance"] == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(df, empty).count() == 0 and decontaminate.contaminated(df.where(F.lit(False)), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_leaks_up_to_the_ratio_are_all_found(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(8, 60))) for i in range(40)]
    docs, want, rates = [], set(), (0.1, 0.12, 0.14, 0.15)
    for i in range(320):
        t, item = items[i % 40]
        text = prose(12) + " " + edits(item, int(rates[i // 40 % 4] * len(item)), rng) + " " + prose(12)
        docs.append((i, text))
        folded = decontaminate.fold(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0].tobytes()
        if decontaminate.edit_search(decontaminate._masks(item.encode()), len(item), folded)[0] <= int(0.15 * len(item)):
            want.add((i, t))
    assert len(want) > 300
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_leaks_of_short_and_unspaced_items_are_found(spark):
    long = "床前明月光疑是地上霜举头望明月低头思故乡白日依山尽黄河入海流"
    items = [(1, "Who wrote Faust?"), (2, "cat"), (3, "今天天气很好"), (4, long), (5, "..."), (6, "x")]
    docs = [(1, "he asked: who wrote -- FAUST? and left"), (2, "concatenate, cats and a bobcat"), (3, "the cat's"), (4, "我说今天天气很好吗"), (5, "前文" + long[:9] + "的" + long[10:] + "后文"), (6, "who wrote Fausts"), (7, "今天天气很坏"), (8, "cat"), (9, "")]
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (3, 2), (4, 3), (5, 4), (8, 2)}
    texts = dict(docs)
    assert {texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode() for r in rows if r["doc_id"] in (1, 3, 4)} == {"who wrote -- FAUST", "cat", "今天天气很好"}
    assert decontaminate.contaminated(spark.createDataFrame([(7, "nothing of them")], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
