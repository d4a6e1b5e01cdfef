"""Exact vector search, pooling and late interaction on array columns, summed up in double precision."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .layout import spread


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, least: float = 1e-9) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(v, v)), F.lit(least)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-18))


def mean_pool(tokens: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Unit mean of the token vectors of each key, component by component."""
    parts = tokens.select(*keys, F.posexplode(vec).alias("d", "x")).groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pooled = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    return pooled.select(*keys, l2_normalise(F.col("mean")).alias("vec"))


#: Queries that go to the passages at one time; passages and queries of one product of matrices.
QUERY_BLOCK, ROWS, SLICE = 20_000, 1024, 512


def pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packs(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_arrays([pa.array([pack(batch.slice(i, rows))], pa.binary())], names=["rows"])

    return run


def _products(k: int, slack: float, key: str, id_type: pa.DataType, key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (block of passages, block of queries): what can be among each query's first k of the task, by the k best scores that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                rows, asked = unpack(batch.column(0)[r]), unpack(batch.column(1)[r])
                scores = matrix(asked.column(1)) @ matrix(rows.column(1)).T
                if rows.num_columns > 2:
                    of, groups = asked.column(2), rows.column(2).dictionary_encode()
                    mine = pc.fill_null(pc.index_in(of, value_set=groups.dictionary), -1).to_numpy()
                    scores[~of.is_null().to_numpy(zero_copy_only=False)[:, None] & (mine[:, None] != pc.fill_null(groups.indices, -2).to_numpy()[None, :])] = -math.inf
                name = tuple(asked.column(0).to_pylist())
                seen = np.concatenate([best[name], scores], axis=1) if name in best else scores
                best[name] = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k:] if seen.shape[1] > k else seen
                floor = best[name].min(1) - slack if best[name].shape[1] == k else np.full(len(scores), -math.inf)
                a, b = np.nonzero((scores >= floor[:, None]) & (scores > -math.inf))
                yield pa.RecordBatch.from_arrays([asked.column(0).take(pa.array(a)).cast(id_type), rows.column(0).take(pa.array(b)).cast(key_type), pa.array(scores[a, b])], names=["query_id", key, "score"])

    return run


def vector_top_k(passages: DataFrame, queries: DataFrame, k: int = 50, key: str = "chunk_id", vec: str = "vec", allowed: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(query_id, key, rank, score): every passage against every query of the batch, by dot product.

    Queries (query_id, vec) are a stated set, which goes to all passages in blocks of QUERY_BLOCK; passages and queries meet as matrices, and a
    task gives back what its own k-th scores leave, so pairs are no rows.  Null vectors score null, behind all others.  Vectors of another length than most and
    those that hold nulls or no finite numbers are scored pair by pair.  With `allowed` (query_id, key) only its pairs are made, by joins on their keys.
    If both have a column grp, a query with a grp meets only passages of that group.
    """
    grouped = "grp" in passages.columns and "grp" in queries.columns
    p = passages.select(key, F.col(vec).alias("p"), *([F.col("grp").cast("string").alias("of")] if grouped else []))
    q = queries.select("query_id", F.col("vec").alias("q"), *([F.col("grp").cast("string").alias("grp")] if grouped else []))
    by_pair = lambda pairs: (pairs.where("grp is null or grp = of") if grouped else pairs).select("query_id", key, dot(F.col("p"), F.col("q")).alias("score"))
    if allowed is not None:
        return rank_scored(by_pair(allowed.select("query_id", key).distinct().join(p, key).join(q, "query_id")), k, key, digits)
    n, width, missing = q.agg(F.count("*"), F.coalesce(F.mode(F.size("q")), F.lit(-1)), F.count_if(F.col("q").isNull())).first()
    blocks = -(-max(n, 1) // QUERY_BLOCK)
    part = lambda rows, b: rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
    plain = lambda c: F.coalesce((F.size(c) == width) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf)), F.lit(False))
    packed = lambda rows, c, size: rows.where(plain(c)).select(rows.columns[0], F.transform(c, lambda x: x.cast("double")).alias("v"), *rows.columns[2:]).mapInArrow(_packs(size), "rows binary")
    ids, keys = queries.schema["query_id"], passages.schema[key]
    run = _products(k, 10.0**-digits, key, to_arrow_type(ids.dataType), to_arrow_type(keys.dataType))
    schema = T.StructType([T.StructField("query_id", ids.dataType), T.StructField(key, keys.dataType), T.StructField("score", T.DoubleType())])
    rows = packed(spread(p), "p", ROWS).withColumnRenamed("rows", "p")
    odd = p.where(~plain("p") & F.col("p").isNotNull())
    few = lambda rows: rows.withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy(key))).where(F.col("nth") <= k).drop("nth") if grouped else rows.orderBy(key).limit(k)
    none = few(p.where("p is null"))  # of what scores null, the first k keys can count
    made = []
    for b in range(blocks):
        asked = packed(part(q, b).coalesce(1), "q", SLICE).withColumnRenamed("rows", "q")
        made.append(rows.crossJoin(F.broadcast(asked)).mapInArrow(run, schema))
        made.append(by_pair(odd.unionByName(none).crossJoin(F.broadcast(part(q, b)))))
    other = q.where(~plain("q") & F.col("q").isNotNull())
    made.append(by_pair(p.where(plain("p")).crossJoin(F.broadcast(other))))
    if missing:
        made.append(by_pair(few(p.where(plain("p"))).crossJoin(F.broadcast(q.where("q is null")))))
    return rank_scored(reduce(DataFrame.unionByName, made), k, key, digits)


def rank_scored(scored: DataFrame, k: int, key: str = "chunk_id", digits: int = 9) -> DataFrame:
    """(query_id, key, rank, score): the best k of (query_id, key, score), equal scores in the order of keys."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "rank", "score")


#: Places of a passage's token vectors that make one matrix.
TOKENS = 1024


def _best_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest product of each vector of `q` with a vector of `p`, row by row: the matrices of one row are copied at a time."""
    for batch in batches:
        n = batch.num_columns - 2
        best = [(matrix(batch.column(n)[r].values) @ matrix(batch.column(n + 1)[r].values).T).max(1) for r in range(batch.num_rows)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in best])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(best) if best else np.zeros(0)))], names=[*batch.schema.names[:n], "best"])


def max_sim(query_tokens: DataFrame, passage_tokens: DataFrame, pairs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): mean over a query's token vectors of the best match among the passage's. Tokens: (query_id, pos, vec) and (key, pos, vec).

    The vectors of a query are one matrix, those of a passage one for each TOKENS places; a pair is one product of matrices
    for each of these, and one row.  All vectors have one length.
    """
    packed = lambda rows, *by: rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda s: F.transform(s["vec"], lambda x: x.cast("double"))).alias("m"))
    q = packed(query_tokens.select("query_id", "pos", "vec"), "query_id").withColumnRenamed("m", "q")
    p = packed(passage_tokens.select(key, "pos", "vec", F.floor(F.col("pos") / TOKENS).alias("block")), key, "block").select(key, F.col("m").alias("p"))
    both = pairs.select("query_id", key).distinct().join(q, "query_id").join(p, key).select("query_id", key, "q", "p")
    schema = T.StructType([both.schema["query_id"], both.schema[key], T.StructField("best", T.ArrayType(T.DoubleType()))])
    parts = both.mapInArrow(_best_matches, schema).groupBy("query_id", key).agg(F.collect_list("best").alias("parts"))
    best = F.aggregate("parts", F.get("parts", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return parts.select("query_id", key, (F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)).alias("score"))
