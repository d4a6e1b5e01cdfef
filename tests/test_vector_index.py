"""The stored vector index against all products, and late interaction against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import vector_index, vectors


def clustered(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    x[n // 3 : n // 2] = x[0]  # a group of copies, whose scores tie
    return x


def plain(x, groups, queries, k):
    out = {}
    for i, q, g in queries:
        scores = [(-round(float(q @ v), 9), j) for j, v in enumerate(x) if g is None or groups[j] == g]
        out[i] = [j for _, j in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("cell, block, first", [(20, 8, 1), (256, 512, 2), (100_000, 512, 2)])
def test_index_is_exact(spark, tmp_path, monkeypatch, cell, block, first):
    for name, value in (("CELL", cell), ("BLOCK", block), ("FIRST", first)):
        monkeypatch.setattr(vector_index, name, value)
    x = clustered(600, 8, cell)
    groups = [["a", "b", None][j % 3] for j in range(600)]
    rows = spark.createDataFrame([(j, v.tolist(), g) for j, (v, g) in enumerate(zip(x, groups, strict=True))] + [(900, None, "a"), (901, [], "b")], "chunk_id bigint, vec array<double>, label string")
    stored = vector_index.ensure(rows, str(tmp_path / "v"), "s", group=F.col("label"))
    rng = np.random.default_rng(7)
    asked = [(i, x[i * 13] + 0.1 * rng.normal(size=8), None) for i in range(15)] + [(100 + i, rng.normal(size=8), ["a", "b", "none"][i % 3]) for i in range(9)]
    q = spark.createDataFrame([(i, v.tolist(), g) for i, v, g in asked] + [(500, None, None)], "query_id int, vec array<double>, grp string")
    for k in (1, 10, 1000):
        got = {}
        for r in sorted(stored.top_k(q, k).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        assert got == {i: w for i, w in plain(x, groups, asked, k).items() if w}


def test_only_cells_within_the_bound_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL", 50)
    x = clustered(2000, 16, 3, spread=0.05)
    rows = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(x)], "chunk_id bigint, vec array<double>")
    stored = vector_index.ensure(rows, str(tmp_path / "v"), "s")
    q = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    found, sent = stored.candidates(q, 10)
    assert found.count() >= 40 * 10
    sizes = {r["cell"]: r["n"] for r in stored.cells.collect()}
    assert sum(sizes.values()) == 2000
    import pyarrow as pa

    read = sum(sizes[r["cell"]] * pa.ipc.open_stream(bytes(r["asked"])).read_next_batch().num_rows for r in sent.collect())
    assert read < 0.5 * 40 * 2000  # of all pairs of question and vector


def test_empty_index_and_other_keys(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, vec array<float>")
    assert vector_index.ensure(none, str(tmp_path / "v"), "none").top_k(q, 3).count() == 0
    some = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", None)], "chunk_id string, vec array<float>")
    got = vector_index.ensure(some, str(tmp_path / "v"), "some").top_k(q, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in got] == [("q", "y", 1, 2.0), ("q", "x", 2, 1.0)]
    assert vector_index.ensure(none, str(tmp_path / "v"), "some").cells.count() > 0  # signed alike: opened, not built


def test_late_interaction_is_that_of_a_loop(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TOKENS", 4)  # passages of several matrices
    rng = np.random.default_rng(2)
    qt = {i: rng.normal(size=(1 + i, 5)) for i in range(4)}
    pt = {j: rng.normal(size=(1 + 3 * j, 5)) for j in range(6)}
    frame = lambda of, key: spark.createDataFrame([(i, n, v.tolist()) for i, m in of.items() for n, v in enumerate(m)], f"{key} bigint, pos bigint, vec array<double>")
    pairs = spark.createDataFrame([(i, j) for i in qt for j in pt if (i + j) % 2] + [(1, 0), (3, 99)], "query_id bigint, chunk_id bigint")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in vectors.max_sim(frame(qt, "query_id"), frame(pt, "chunk_id"), pairs).collect()}
    want = {(i, j): float((qt[i] @ pt[j].T).max(1).mean()) for i in qt for j in pt if (i + j) % 2}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
