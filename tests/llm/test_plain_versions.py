"""Operators without SQL against plain versions of their cores: pair sums, matrices of counts, trees."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import sharding, toxicity, urls


def test_pair_sums_are_those_of_a_double_loop():
    rng = np.random.default_rng(3)
    known = np.sort(rng.choice(500, 40, replace=False))
    machine = toxicity.Machine(0.3, known, rng.normal(size=40), rng.normal(size=(40, 4)))
    texts = [np.sort(rng.choice(500, n, replace=False)) for n in (0, 1, 2, 30, 200)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = machine.raw(np.concatenate(texts), at)
    for t, score in zip(texts, got, strict=True):
        mine = [int(np.flatnonzero(known == x)[0]) for x in t if x in known]
        want = machine.bias + sum(machine.weight[i] for i in mine) + sum(float(machine.factors[i] @ machine.factors[j]) for a, i in enumerate(mine) for j in mine[a + 1 :])
        assert abs(score - want) < 1e-9


def test_the_pair_sum_is_what_a_fit_learns():
    """Labels that are the exclusive or of two terms: the machine's pair term tells them, its single weights can't."""
    rng = np.random.default_rng(5)
    rows = [np.sort(np.concatenate([np.flatnonzero(rng.random(2) < 0.5), 10 + rng.choice(20, 5, replace=False)])) for _ in range(2000)]
    y = np.array([(0 in r) == (1 in r) for r in rows], float)
    t, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    m = toxicity.fit(t, at, y, rounds=40, rate=0.2)
    right = ((m.raw(t, at) >= 0) == (y > 0)).mean()
    alone = toxicity.Machine(m.bias, m.known, m.weight, np.zeros_like(m.factors))
    assert right > 0.95 and ((alone.raw(t, at) >= 0) == (y > 0)).mean() < 0.75


def test_counts_have_the_law_of_plain_permutations():
    """Each matrix turns up as often as shuffled rows, cut into shards, give it: exactly, and as drawn."""
    rows, cols, n = [4, 3, 2], [3, 3, 3], 6000
    lines = [[x for x in itertools.product(range(4), repeat=3) if sum(x) == r] for r in rows]
    chance = {}
    for m in itertools.product(*lines):
        if [sum(c) for c in zip(*m, strict=True)] == cols:
            chance[m] = math.prod(math.factorial(x) for x in rows + cols) / math.factorial(9) / math.prod(math.factorial(x) for line in m for x in line)
    assert abs(sum(chance.values()) - 1) < 1e-12
    drawn, plain, rng = dict.fromkeys(chance, 0), dict.fromkeys(chance, 0), np.random.default_rng(1)
    of = np.repeat(np.arange(3), rows)
    for seed in range(n):
        drawn[tuple(map(tuple, sharding.matrix(rows, cols, seed)))] += 1
        mixed = rng.permutation(of).reshape(3, 3)
        plain[tuple(tuple(int((mixed[s] == p).sum()) for s in range(3)) for p in range(3))] += 1
    for counts in (drawn, plain):
        chi = sum((counts[m] - n * p) ** 2 / (n * p) for m, p in chance.items())
        free = len(chance) - 1
        assert chi < free + 5 * math.sqrt(2 * free), (chi, free)


def test_which_shard_a_row_meets_is_uniform(spark):
    """Over seeds, each row is in each shard, and in each slot of it, as often as in a plain shuffle."""
    docs = spark.createDataFrame([(i, f"text {i}", 0) for i in range(6)], "doc_id bigint, text string, slot int")
    seen = np.zeros((6, 2, 3))
    for seed in range(30):
        for r in sharding.shards(docs, 2, seed=seed).collect():
            seen[r["doc_id"], r["shard"], r["slot"]] += 1
    assert (seen.sum((1, 2)) == 30).all() and (seen.sum(0) == 30).all()
    chi = ((seen - 5.0) ** 2 / 5.0).sum()
    assert chi < 25 + 5 * math.sqrt(50), chi


def walked(node, x):
    """The value of the leaf that x comes to."""
    while node.getClass().getSimpleName().startswith("Internal"):
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_trees_judge_as_a_plain_walk_does(spark, monkeypatch):
    """Scores of url_verdicts against each tree walked by hand over features counted by hand."""
    held = {}
    fit = urls.GBTClassifier.fit

    def keep(self, rows):
        held["model"] = fit(self, rows)
        return held["model"]

    monkeypatch.setattr(urls.GBTClassifier, "fit", keep)
    learn = spark.createDataFrame([(f"http://h{i % 7}.a{'bc'[i % 2]}.org/{'p/' * (i % 5)}{'x' * (i % 11)}?{'&'.join(f'k{j}=1' for j in range(i % 4))}", int(i % 4 > 1 or i % 11 > 8)) for i in range(600)], "url string, label int")
    asked = [f"http://h{i}.ab.org/{'q/' * i}y-{i}?a={i}&b=2#f" for i in range(12)] + ["nothing", "", None, "http://x.com/" + "long/" * 5000, "http://é.org/ü?x"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id bigint, url string")
    scores = {r["page_id"]: r["score"] for r in urls.url_verdicts(pages, [], labels=learn).collect()}
    labels = [(r["url"], r["label"]) for r in learn.collect()]
    share = sum(y for _, y in labels) / len(labels)
    suffix = lambda host: host.rsplit(".", 1)[-1]
    host_of = lambda u: u.split("://", 1)[1].replace("?", "/").replace("#", "/").split("/")[0].lower() if "://" in u else ""
    stats = {}
    for u, y in labels:
        n, bad = stats.get(suffix(host_of(u)), (0, 0))
        stats[suffix(host_of(u))] = n + 1, bad + y

    def plain(u):
        u = u or ""
        host = host_of(u)
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:].split("?")[0].split("#")[0]
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        n, bad = stats.get(suffix(host), (0, 0))
        shares = [u.count(c) / len(u) for c in set(u)]
        known = suffix(host) in stats
        values = {"f_length": len(u), "f_host": len(host), "f_labels": host.count("."), "f_depth": path.count("/"), "f_path": len(path), "f_digits": sum(c in "0123456789" for c in u) / max(len(u), 1), "f_entropy": -sum(p * math.log2(p) for p in shares),
                  "f_params": query.count("&") + 1 if query else 0, "f_query": len(query), "f_hyphens": u.count("-"), "f_fragment": float("#" in u), "f_suffix": (bad + 4 * share) / (n + 4) if known else share, "f_suffix_rows": math.log2(n + 1) if known else 0.0}
        return [float(values[f]) for f in urls.FEATURES]

    model = held["model"]
    for i, u in enumerate(asked):
        margin = sum(w * walked(t._java_obj.rootNode(), plain(u)) for w, t in zip(model.treeWeights, model.trees, strict=True))
        assert abs(scores[i] - 1 / (1 + math.exp(-2 * margin))) < 1e-9, (u, i)
    assert len({round(s, 6) for s in scores.values()}) > 2


def test_labels_other_than_two_and_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000, "clash"), (2, None, ""), (None, "http://a.org/", "")], "page_id bigint, url string, score string")
    labels = spark.createDataFrame([("http://a.org/1", 1), ("http://b.org/2", 0), (None, 1), ("http://c.org/", None)], "url string, label int")
    got = urls.url_verdicts(pages, [("allow", "org/")], labels=labels).select("page_id", "rule", "verdict").orderBy(F.col("page_id").asc_nulls_last()).collect()
    assert [(r["page_id"], r["rule"], r["verdict"]) for r in got][0] == (1, "org/", "allow") and len(got) == 3 and got[2]["rule"] == "org/"
