import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import mixing, negatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share, most):
    """Literal reading: share by weight, stop at the cap, share the excess anew until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()) * share, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else left * weight[s] / w for s in names}
        capped |= over


def plain_mix(rows, weights=(5, 2, 1), share=1.0, most=3, seed=11):
    counted = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in counted:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = plain_targets(sizes, weights, share, most), []
    for s in sizes:
        mine = sorted(((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n) for i, n, x in counted if x == s))
        budget = math.floor(goal[s] + 0.5)
        whole, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        at = 0
        for _, known, i, n in mine:
            out.append((i if known else None, n, sizes[s], round(goal[s], 6), whole * n + max(0, min(n, rest - at))))
            at += n
    return sorted(out, key=str)


def mixed(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, source string, size int, grp int, place int")
    return sorted(((*r[:3], round(r[3], 6), r[4]) for r in map(tuple, mixing.mix(docs, **how).collect())), key=str)


def test_mix_is_that_of_a_plain_pass(spark):
    rng = random.Random(4)
    names = ["b", "a", "é", "Z", None, "c"]
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 3, 40]))), rng.choice(names)) for i in range(300)]
    rows += [(900, "one two", "tiny"), (901, None, "empty"), (902, "", "empty"), (None, "a b c", "a"), (None, "a b", "a"), (7, "x y z", "b"), (7, "x y z", "b"), (7, "x y z", "b")]
    rows += [(950, "v " * 100_000, "c"), (951, "   \x0b\x1c", "a")]
    for how in ({}, {"share": 0.4}, {"weights": (1, 9)}, {"share": 5.0}):
        got = mixed(spark, rows, **how)
        assert got == plain_mix(rows, **how)
        assert all(0 <= taken <= 3 * size for _, size, _, _, taken in got)
    assert mixed(spark, rows) == mixed(spark, rows[::-1])


def test_each_source_reaches_its_target_and_the_mix_can_be_read(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(1 + i % 7)), f"s{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("epoch", F.lit("clash"))
    plan = mixing.mix(docs)
    sums = plan.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(r["t"] == math.floor(r["g"] + 0.5) for r in sums)
    taken, texts = {r["doc_id"]: r["taken"] for r in plan.collect()}, {i: t for i, t, _ in rows}
    seen = {}
    for r in mixing.passes(docs, plan).collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + len(r["text"].split())
        assert texts[r["doc_id"]].startswith(r["text"]) and len(r["text"].split()) == r["words_taken"]
    assert seen == {i: t for i, t in taken.items() if t}


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(docs).count() == 0
    assert mixed(spark, [(1, None, None), (2, "", "a")]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def plain_negatives(rows, positives=5, negatives_=10):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, label, tuple(math.floor(256 * x) for x in v)))
    kept = list(dict.fromkeys(kept))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  shorter ones are followed by zeros
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        every = sorted(((-score(v, w), j, m) for j, m, w in kept if j != i))
        near = [(-s, j) for s, j, m in every if m == label][:positives]
        for p, j in near:
            hard = [(-s, k) for s, k, m in every if m != label and 30 * p <= -100 * s <= 90 * p][:negatives_]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(hard)]
    return sorted(out)


def found_negatives(spark, rows):
    table = spark.createDataFrame([(i, v, label, "x", 0.0) for i, label, v in rows], "vec_id bigint, embedding array<double>, label int, part string, norm double")
    out = negatives.hard_negatives(table, anchor=F.col("vec_id") % 100 == 0)
    return sorted(map(tuple, out.collect()))


def vectors(rng, n, dim=6, labels=4, copies=0.3):
    made = []
    for i in range(n):
        if made and rng.random() < copies:
            made.append((i, rng.randrange(labels), rng.choice(made)[2]))
        else:
            v = rng.normalvariate
            made.append((i, rng.randrange(labels), [v(0, 1) for _ in range(dim)]))
    return made


@pytest.mark.parametrize("page, first", [(8, 1), (1024, 8)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, page, first):
    """Also with pages of a few rows and one segment a turn, so that intervals are left out and many turns are made."""
    monkeypatch.setattr(negatives, "PAGE", page)
    monkeypatch.setattr(negatives, "FIRST", first)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    rng = random.Random(page)
    rows = vectors(rng, 900)
    hot = [rng.normalvariate(0, 1) for _ in range(6)]
    rows += [(1000 + i, 1, hot) for i in range(300)]  # a group of copies with its own anchors
    rows += [(2000 + i, 2, [x + 0.01 * rng.random() for x in hot]) for i in range(60)]
    assert found_negatives(spark, rows) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rng = random.Random(2)
    rows = vectors(rng, 250, dim=4)
    rows += [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0]), (303, 2, [math.nan] * 4), (304, 2, [math.inf] * 4)]
    rows += [(400, 1, []), (401, 2, []), (402, 1, [2.0]), (500, 2, [0.5] * 9), (501, 3, [0.4] * 9)]  # other lengths
    rows += [(600, 9, [1.0] * 4), (700, 3, [1e-9] * 4), (0, 1, rows[0][2]), (0, rows[0][1], rows[0][2]), (800, 1, [3e9, 0.0, 0.0, 0.0]), (801, 2, [2e9, 0.0, 0.0, 0.0]), (802, 1, [2.5e9, 0.0, 0.0, 0.0])]
    got, want = found_negatives(spark, rows), plain_negatives(rows)
    limit = 2**63 - 1
    inside = lambda rows: [r for r in rows if max(abs(r[4]), abs(r[5])) < limit]  # noqa: E731  beyond a long scores end at its ends
    assert inside(got) == inside(want)
    assert found_negatives(spark, []) == []
    assert found_negatives(spark, [(100, 1, [1.0])]) == []


def test_intervals_are_left_out():
    """On vectors in tight clusters a search leaves out most of the rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 4
    x = np.concatenate([c + 0.02 * rng.normal(size=(300, 16)) for c in centres])
    norm = np.einsum("ij,ij->i", x, x)
    keys = negatives.Keys(x, norm, float(norm.max()), 20)
    near, dist = keys.of_rows(x, norm)
    q = x[:1]
    bound = np.maximum(0.0, np.abs(keys.of_anchors(q, norm[:1])[0][near] - dist))
    true = np.sqrt(np.maximum(0, norm[0] + norm.max() - 2 * (x @ q[0])))
    assert (bound <= true + 1e-6).all()
    tenth = np.sort(true)[9]
    assert (bound <= tenth).mean() < 0.5
