import random

import corpus_pipeline
from tests.llm.test_dedup import brute_components, brute_windows, shingles


def make(tmp_path, spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, toxic = [], {}
    items = [(i, prose(25)) for i in range(5)]
    passage = prose(60)
    for i in range(1500):
        body = prose(60)
        toxic[i] = int(i % 6 == 0)
        if toxic[i]:
            body += " vilewretch " + prose(3) + " foulscum"
        elif i % 10 == 1:
            body += " " + passage + " " + prose(10)
        elif i % 10 == 3:
            body += " " + items[i % 5][1]
        rows.append((i, body, "en", "s", len(body)))
    rows += [(3000 + i, rows[5][1] + f" tail{i}", "en", "s", 1) for i in range(4)] + [(4000, None, None, None, None), (4001, "", "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, toxic, items


def test_stages(spark, tmp_path):
    d, toxic, items = make(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        outs[name] = docs
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            continue
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        if name == "toxicity":
            bad, gone = {i for i, y in toxic.items() if y}, set(before) - set(after)
            assert gone <= bad and len(gone) >= 0.97 * len(bad)
        elif name == "near_dedup":
            sets = {i: shingles(t, 5) for i, t in before.items()}
            root = brute_components([(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], sets)
            assert set(after) == {i for i in sets if root[i] == i}
        elif name == "substring_dedup":
            want = brute_windows([(i, t) for i, t in before.items()], corpus_pipeline.PASSAGE)
            assert after == {i: (w[3] if w[1] else before[i]) for i, w in want.items()} and any(w[1] for w in want.values())
        else:
            assert set(before) - set(after) == {i for i, t in before.items() if any(x in (t or "") for _, x in items)}
    assert corpus_pipeline.run(spark, d).count() == outs["packing"].count()
