"""BM25 over postings: an inverted join per batch of queries instead of a scan per term."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from .index import written
from .layout import spread

#: Fixed values of the ranking.
K1, B = 1.5, 0.75
CANDIDATES = 50
#: Bytes of texts that are tokenized at one time, questions that are sent to every task at one time, and scores that a task holds.
TEXT_BYTES, QUERIES, SCORES = 1_000_000, 20_000, 200_000
#: What a byte of a text in lower case is to X.TOKEN: 1 may begin a token, 2 may only continue it.
_KIND = np.array([1 if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" else 2 if chr(i) in "-." else 0 for i in range(256)], np.uint8)


def arrow_tokens(texts: pa.Array) -> pa.ListArray:
    """X.tokenize of texts in lower case, none of them null, in a worker: tokens are runs of bytes, found for all texts at once."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text ends here
    edge[at] = True
    inside = kind > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    late = np.flatnonzero(kind[start] == 2)
    if len(late):  # a run may open with hyphens and dots, which no token does
        first = np.append(np.flatnonzero(kind == 1), len(raw))
        start[late] = first[np.searchsorted(first, start[late])]
        start, end = start[start < end], end[start < end]
    plural = (end - start > 3) & (raw[end - 1] == ord("s"))
    plural[plural] = raw[end[plural] - 2] != ord("s")
    again = 1 + plural
    start, end = np.repeat(start, again), np.repeat(end, again)
    end[(np.cumsum(again) - 1)[plural]] -= 1
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = raw[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
    values = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(words)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, at).astype(np.int32)), values)


def tokenized(batches: Iterator[pa.RecordBatch], name: str = "tokens") -> Iterator[pa.RecordBatch]:
    """Batches whose column `name` holds texts in lower case, with their tokens instead; TEXT_BYTES of texts, one at least, are in a batch."""
    for batch in batches:
        place = batch.schema.get_field_index(name)
        size = np.cumsum(pc.binary_length(batch.column(place)).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + TEXT_BYTES, "right")))
            part = batch.slice(i, j - i)
            yield part.set_column(place, name, arrow_tokens(part.column(place)))
            i = j


def lower(column: str) -> Column:
    """What `tokenized` reads."""
    return F.lower(X.text(F.col(column)))


def lengths(chunks: DataFrame, field: str, key: str = "chunk_id") -> DataFrame:
    """(key, dl): tokens of each chunk, empty ones too."""
    return spread(chunks.select(key, field)).select(key, F.size(X.tokenize(F.col(field))).alias("dl"))


def postings(chunks: DataFrame, field: str, key: str = "chunk_id", only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf). With `only` (term), other terms go before the shuffle."""
    terms = spread(chunks.select(key, field)).select(key, F.explode(X.tokenize(F.col(field))).alias("term"))
    if only is not None:
        terms = terms.join(only.select("term").distinct(), "term", "left_semi")
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def corpus_stats(lens: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return lens.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def term_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); idf is over the whole corpus and never below zero."""
    idf = F.log((F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + F.lit(1.0))
    return posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"))


def query_terms(queries: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, term), each term once a query."""
    return queries.select("query_id", F.explode(F.array_distinct(X.tokenize(F.col(text_col)))).alias("term"))


def _held(wanted: list[str], key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (key, family, role, tokens): what stands before the tokens, length, and which of the wanted terms are in it how often."""
    terms = pa.array(wanted, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokenized(batches):
            tokens = batch.column("tokens")
            sizes = np.diff(tokens.offsets.to_numpy())
            code = pc.fill_null(pc.index_in(tokens.values, value_set=terms), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
            both, tf = np.unique(row * len(wanted) + code[code >= 0], return_counts=True)
            edges = pa.array(np.searchsorted(both, np.arange(len(sizes) + 1) * len(wanted)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (both % max(len(wanted), 1), tf)]
            about = [batch.column("key").cast(key), *[batch.column(c).cast(pa.string()) for c in ("family", "role")]]
            yield pa.RecordBatch.from_arrays([*about, pa.array(sizes.astype(np.int64)), *lists], names=["key", "family", "role", "dl", "term", "tf"])

    return run


#: (family, role, by_role) of a route, and the numbers of its questions.
Routes = dict[tuple[str | None, str | None, bool], list[int]]


def _weighed(ids: pa.Array, asks: list[np.ndarray], idf: np.ndarray, mean: float, key: str, k: int | None = None, routes: Routes | None = None, slack: float = 2e-9) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of rows (key, dl, term, tf) for every question that shares a term with them. asks: the questions' numbers, term by term.

    With a k, of those that the questions' routes admit (by family and role of the rows) what can be among each one's first k of the task, by the k best scores seen so far.
    """
    n = len(ids)
    counts = np.array([len(a) for a in asks], np.int64)
    first, of = np.cumsum(counts) - counts, np.concatenate([np.zeros(0, np.int64), *asks]).astype(np.int64)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Some rows, and their scores for all questions."""
        for batch in batches:
            step = max(1, SCORES // max(n, 1))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                sizes = np.diff(part.column("term").offsets.to_numpy())
                term, tf = (pc.list_flatten(part.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "tf"))
                row = np.repeat(np.arange(part.num_rows), sizes)
                norm = K1 * (1.0 - B + B * part.column("dl").to_numpy().astype(np.float64) / (mean or 1.0))
                weight = idf[term] * tf * (K1 + 1) / (tf + norm[row])
                times = counts[term]
                begin = np.cumsum(times) - times
                question = of[np.repeat(first[term] - begin, times) + np.arange(times.sum())]
                yield part, np.bincount(np.repeat(row, times) * n + question, np.repeat(weight, times), part.num_rows * n).reshape(part.num_rows, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = np.zeros((k or 0, n)), np.zeros(n)
        for part, scores in matrices(batches):
            for (family, role, by_role), mine in (routes or {}).items():
                admitted = np.ones(part.num_rows, bool)
                for name, value in (("family", family), ("role", role if by_role else None)):
                    if value is not None:
                        admitted &= pc.fill_null(pc.equal(part.column(name), value), False).to_numpy(zero_copy_only=False)
                scores[np.ix_(~admitted, mine)] = 0.0
            rows, asked = np.nonzero((scores > 0) & (scores >= floor))
            if k is not None and len(rows):
                some = np.unique(asked)
                seen = np.concatenate([best[:, some], scores[:, some]])
                best[:, some] = np.partition(seen, len(seen) - k, axis=0)[-k:]
                floor[some] = best[:, some].min(0) - slack
                left = scores[rows, asked] >= floor[asked]
                rows, asked = rows[left], asked[left]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked)), part.column("key").take(pa.array(rows)), pa.array(scores[rows, asked])], names=["query_id", key, "score"])

    return run


def bm25_scores(chunks: DataFrame, queries: DataFrame, field: str = "page_content", key: str = "chunk_id", text_col: str = "question") -> DataFrame:
    """(query_id, key, score) of all chunks that share a term with a query.

    Texts are read once, for their lengths and for what they hold of the queries' terms, which is written down. From that the statistics are counted and
    each row is scored where it lies: neither postings nor pairs are shuffled. Queries are a stated set that goes to every task, QUERIES at a time.
    Only rows that share a key meet in a shuffle. keyword_index stores postings of all terms.
    """
    return _scored(chunks, queries, field, key, text_col)


def _scored(chunks: DataFrame, queries: DataFrame, field: str, key: str, text_col: str, k: int | None = None, rules: DataFrame | None = None) -> DataFrame:
    """bm25_scores, or of what `rules` admit all that can be among the first k of a question. With a k only few rows of each task leave it."""
    spark, asked = chunks.sparkSession, query_terms(queries, text_col)
    blocks = max(1, -(-queries.count() // QUERIES))
    if blocks > 1:
        return reduce(DataFrame.unionByName, [_scored(chunks, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), field, key, text_col, k, rules) for b in range(blocks)])
    known = asked.toArrow()
    kind, id_kind = chunks.schema[key].dataType, queries.schema["query_id"].dataType
    terms, ids = (known.column(c).combine_chunks().dictionary_encode("encode") for c in ("term", "query_id"))
    wanted = terms.dictionary.to_pylist()
    pairs = np.unique(terms.indices.to_numpy().astype(np.int64) * max(len(ids.dictionary), 1) + ids.indices.to_numpy())
    asks = np.split(pairs % max(len(ids.dictionary), 1), np.searchsorted(pairs, np.arange(1, len(wanted)) * len(ids.dictionary))) if wanted else []
    held = T.StructType([T.StructField("key", kind), *[T.StructField(c, T.StringType()) for c in ("family", "role")], T.StructField("dl", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("term", "tf")]])
    mark = lambda c: (F.col(c).cast("string") if rules is not None else F.lit(None).cast("string")).alias(c.removeprefix("doc_"))
    read = spread(chunks.select(F.col(key).alias("key"), mark("doc_family"), mark("doc_role"), field))
    rows = written(read.select("key", "family", "role", lower(field).alias("tokens")).mapInArrow(_held(wanted, to_arrow_type(kind)), held), "held")
    n, mean = rows.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    same = written(rows.groupBy(F.col("key").alias("same")).agg(F.count("*").alias("n")).where("n > 1 or same is null"), "repeated")
    alone = rows
    twins = None
    if not same.isEmpty():  # rows of one key count as one in df, and each of them is scored by the terms of all
        met = F.col("key").eqNullSafe(F.col("same"))
        alone, twins = rows.join(same, met, "left_anti"), rows.join(same, met, "left_semi")
        sums = twins.select("key", F.explode(F.arrays_zip("term", "tf")).alias("p")).groupBy("key", F.col("p.term").alias("t")).agg(F.sum("p.tf").cast("int").alias("f"))
        joint = sums.groupBy(F.col("key").alias("same")).agg(F.collect_list(F.struct("t", "f")).alias("p")).select("same", F.transform("p", lambda x: x["t"]).alias("term"), F.transform("p", lambda x: x["f"]).alias("tf"))
        joint = written(joint, "joint")
        twins = twins.select("key", "family", "role", "dl").join(joint, F.col("key") == F.col("same")).select("key", "family", "role", "dl", "term", "tf")
    counted = alone.select("term") if twins is None else alone.select("term").unionByName(joint.select("term"))
    df = np.zeros(len(wanted))
    for t, c in counted.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row a term of the queries at most
        df[t] = c
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
    schema = T.StructType([T.StructField("query_id", id_kind), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    if not wanted:
        return spark.createDataFrame([], schema)
    ids, routes = ids.dictionary, {}
    if rules is not None:
        number = {q: i for i, q in enumerate(ids.to_pylist()) if q is not None}
        for r in rules.select("query_id", "family", "role", "by_role").collect():  # a row a question at most
            if r["query_id"] in number and r["by_role"] is not None:
                routes.setdefault((r["family"], r["role"], r["by_role"]), []).append(number[r["query_id"]])
    ids = ids.cast(to_arrow_type(id_kind))
    made = alone.mapInArrow(_weighed(ids, asks, idf, mean, key, k, routes), schema)
    if twins is None:
        return made
    pairs = twins.mapInArrow(_weighed(ids, asks, idf, mean, key), schema).groupBy("query_id", key).agg(F.sum("score").alias("score"))
    if rules is not None:  # each of the rows that share a key is admitted or not
        from .fusion import restrict

        pairs = restrict(pairs, twins.select(F.col("key").alias(key), F.col("family").alias("doc_family"), F.col("role").alias("doc_role")), rules, key)
    return made.unionByName(pairs)


def top_k(scores: DataFrame, k: int = CANDIDATES, key: str = "chunk_id", digits: int = 9) -> DataFrame:
    """(query_id, key, rank, score): best first; equal scores (to `digits`) in the order of keys, none of zero."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), key)
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "rank", "score")


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None, field: str = "page_content", key: str = "chunk_id", text_col: str = "question", rules: DataFrame | None = None) -> DataFrame:
    """Ranked chunks per query, from texts that are read once, as for bm25_scores; a task keeps the first k of each query.

    Restrictions of the result, not of the statistics: `rules` (query_id, family, role, by_role, as fusion.routes gives them) are applied where rows are
    scored, by doc_family and doc_role of the chunks; `allowed` (query_id, key) is met by all scored pairs.
    """
    if allowed is None:
        return top_k(_scored(chunks, queries, field, key, text_col, k, rules), k, key)
    return top_k(bm25_scores(chunks, queries, field, key, text_col).join(allowed, ["query_id", key], "left_semi"), k, key)


def title_field(chunks: DataFrame) -> DataFrame:
    """Adds title_text, clause number and heading: the second index."""
    return chunks.withColumn("title_text", F.concat_ws(" ", X.text(F.col("clause_id")), X.text(F.col("heading"))))
