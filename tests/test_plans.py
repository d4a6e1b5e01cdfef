"""Queries over whole tables, held against plain Python and, where DuckDB is there, their SQL."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from evidentia.plans import base, catalogue

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return [tuple(r) for r in catalogue.queries()[name](spark, SF).collect()]


def read(name, *columns):
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pylist()]


def test_maxsim_takes_all_query_vectors(spark):
    v = [(i, label, np.array(e, dtype=np.float64)) for i, label, e in read("embeddings", "vec_id", "label", "embedding")]
    tokens = [(i // 500, e) for i, _, e in v if i % 50 == 0]
    want = {}
    for label in {x for _, x, _ in v if x is not None}:
        own = np.array([e for _, x, e in v if x == label])
        for q in {q for q, _ in tokens}:
            want[q, label] = np.mean([(own @ e).max() for k, e in tokens if k == q])
    got = {(q, c): s for q, c, s in run(spark, "maxsim")}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert len({q for q, _ in got}) == len({i // 500 for i, _, _ in v if i % 50 == 0})


def test_routes_see_all_documents(spark):
    docs = read("documents", "doc_id", "lang", "source")
    routes = [(1, "en", "src0"), (2, "de", "src99"), (3, "xx", None), (4, None, None), (5, None, "src3"), (6, "fr", None), (7, "es", "src7")]
    want = set()
    for q, family, role in routes:
        f = [x for x in docs if family is None or x[1] == family]
        b = [x for x in f if role is not None and x[2] == role]
        want |= {(q, x[0]) for x in (b if len(b) >= 3 else f if len(f) >= 3 else docs)}
    assert set(run(spark, "route_fallback")) == want and len(docs) == len({c for q, c in want if q == 4})


def test_widening_takes_whole_vector_lists(spark):
    v = [(i, label, np.array(e, dtype=np.float64)) for i, label, e in read("embeddings", "vec_id", "label", "embedding")]
    want = set()
    for i, label, e in v:
        if i % 50 == 0:
            ranked = sorted(v, key=lambda p: (-round(float(p[2] @ e), 9), p[0]))
            narrow = [p for p in ranked if label is not None and p[1] == label][:5]
            want |= {(i, p[0]) for p in (narrow if len(narrow) >= 3 else ranked[:10])}
    assert set(run(spark, "widen_search")) == want


@pytest.mark.parametrize("name", ["maxsim", "route_fallback", "widen_search"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rounded = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(run(spark, name)) == rounded(con.execute(base.SQL[name]).fetchall())
