import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.llm import _blocks, embeddings, minhash, substring, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, n_words int, block string, rows string"


def docs_of(spark, texts):
    """Rows with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, None, 7, "b", None) for i, t in texts], SCHEMA)


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3):
    """Copies, near copies around the threshold, shared passages, edges."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "One", "two words", "TWO words", "x" * 5000, "é ü\u00a0ß a", "tail"]
    base = prose(rng, 120)
    for k in range(60):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    passage = " ".join(prose(rng, 40))
    for k in range(40):
        texts.append(" ".join(prose(rng, rng.randrange(5, 90))) + "\n" + (passage if k % 3 else "") + " " + " ".join(prose(rng, 30)))
    texts += texts[20:30]
    texts.append("again and again " * 60)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "threshold"), [(3, (85, 100)), (5, (4, 5))])
def test_near_duplicates_equal_brute_force(spark, k, threshold):
    rows = corpus()
    sets = {i: shingles(t, k) for i, t in rows}
    num, den = threshold
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = brute_components(links, sets)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(spark, rows), k=k, threshold=threshold).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_large_open_group_is_settled_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = prose(rng, 100, 10**6)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(100)] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 3) for i, t in rows}
    want = brute_components([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])], sets)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows), k=3, threshold=(85, 100)).collect()}
    assert got == want


def test_near_duplicates_edges(spark):
    null_ids = docs_of(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(null_ids).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.drop_near_duplicates(null_ids).collect()) == [0, 1, 1]
    assert minhash.expected_miss(0.85) < 1e-6 and minhash.expected_miss(0.8) < 1e-6


def brute_windows(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        off = [False] * len(w)
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                off[s : s + n] = [True] * n
            seen.add(key)
        kept = " ".join(x for x, o in zip(w, off, strict=True) if not o)
        out[i] = (len(w), sum(off), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window", [2, 5, 20, 40])
def test_window_dedup_equals_brute_force(spark, window):
    rows = corpus(5)
    got = {r["doc_id"]: r for r in substring.dedup_windows(docs_of(spark, rows), window=window).collect()}
    want = brute_windows(rows, window)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    texts = dict(rows)
    assert all(r["text"] == (want[i][3] if want[i][1] else texts[i]) for i, r in got.items())
    assert got[0]["lang"] is None and got[0]["block"] == "b"


def test_window_dedup_edges(spark):
    t = " ".join(f"w{i}" for i in range(30))
    got = [(r["doc_id"], r["n_removed"]) for r in substring.dedup_windows(docs_of(spark, [(None, t), (1, t), (1, t)]).coalesce(1)).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (1, 30), (1, 30)], key=str)
    assert substring.dedup_windows(docs_of(spark, [])).count() == 0
    assert substring.difference_cover(20) == (13, [0, 1, 3, 9])


@pytest.mark.parametrize("hot", [0, 2, 10**9])
def test_byte_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(_blocks, "HOT", hot)
    rows = [*corpus(7), (900, "é" * 400), (901, "aé" * 300), (902, "z" * 99), (903, "z" * 100), (904, "z" * 260)]
    got = {r["doc_id"]: r for r in suffix.dedup_bytes(docs_of(spark, rows).repartition(3, "doc_id"), length=100).collect()}
    want = suffix.brute_force(rows, 100)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    texts = dict(rows)
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        for s in reversed(r["spans"]):
            raw = raw[: s["start"]] + raw[s["start"] + s["length"] :]
        assert hashlib.sha256(raw).hexdigest() == r["kept_sha256"]
    assert suffix.dedup_bytes(docs_of(spark, []), length=100).count() == 0


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(12)]
    every = {}
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + 5, len(x) + 1):
                every.setdefault(x[i:j], []).append((t, i))
    want = set()
    for s, at in every.items():
        before = {texts[t][i - 1] if i else -1 - n for n, (t, i) in enumerate(at)}
        after = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else -1 - n for n, (t, i) in enumerate(at)}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want.add((len(s), tuple(sorted(at))))
    got = {(n, tuple(sorted(at))) for n, at in suffix.maximal_repeats(texts, 5)}
    assert got == want


@pytest.mark.parametrize(("hot", "size"), [(10**9, 1 << 10), (10**9, 1 << 22), (1, 1 << 10)])
def test_repeat_groups_list_all_occurrences(spark, monkeypatch, hot, size):
    monkeypatch.setattr(_blocks, "HOT", hot)
    monkeypatch.setattr(_blocks, "BLOCK_BYTES", size)
    rows = [*corpus(8)[:60], (900, "é" * 200), (901, "z" * 99), (902, "z" * 130), (None, corpus(8)[30][1])]
    got = suffix.repeat_groups(docs_of(spark, rows).coalesce(2), length=100).collect()
    raw = {i: (t or "").encode() for i, t in rows}
    groups: dict = {}
    for r in got:
        groups.setdefault(r["group"], []).append((r["doc_id"], r["start"], r["length"]))
    covered = {i: [False] * len(t) for i, t in raw.items()}
    for places in groups.values():
        strings = {raw[i][a : a + n] for i, a, n in places}
        assert len(strings) == 1 and len(places) == len(set(places)) > 1
        one = strings.pop()
        every = [(i, a, len(one)) for i, t in raw.items() for a in range(len(t) - len(one) + 1) if t.startswith(one, a)]
        assert sorted(places, key=str) == sorted(every, key=str) and len(one) >= 100
        for i, a, n in sorted(places, key=lambda p: (-1 if p[0] is None else p[0], p[1]))[1:]:
            covered[i][a : a + n] = [True] * n
    want = suffix.brute_force([(-1 if i is None else i, t) for i, t in rows], 100)
    assert {-1 if i is None else i: sum(c) for i, c in covered.items()} == {i: w[1] for i, w in want.items()}


def test_vectors_equal_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v], "a" if i % 3 else "b", "extra"))
    rows += [(300, None, "a", ""), (301, [0.0] * 8, "a", ""), (302, [float("nan")] * 8, "a", ""), (303, [1.0, None], "a", ""), (304, [1.0] * 8, None, ""), (305, [], "a", ""), (306, [1.0] * 9, "a", ""), (None, rows[0][1], "a", "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    plain = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab, _ in rows[:240]]
    links = [(a, b) for a, x, la in plain for b, y, lb in plain if a < b and la == lb and float(x @ y) >= 0.98]
    root = brute_components(links, [r[0] for r in rows if r[0] is not None])
    for i in root:
        assert got[i] == (sum(i in p for p in links), root[i], root[i] == i), i
    assert got[None] == (0, None, True)
    assert embeddings.near_duplicate_vectors(df.where(F.lit(False))).count() == 0
