"""A stored keyword index: the corpus is tokenized once, questions read the postings of their own terms.

Documents lie in cells of a few thousand. One table holds, for each field, a row a cell (its documents' keys, lengths, families and roles) and a row
a term and cell (the documents that hold it, and how often), partitioned by field and by a bucket of the term's hash: a batch of questions
reads only the folders of its terms' buckets. The postings that it names travel to their cells, each once a batch, and a task
gives back the best k of each question over all its cells. Pairs of question and document are never made.

Inside a cell, blocks of BLOCK documents have a bound, the sum of the largest weights of the question's terms: those below the k-th
score found so far are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import index, lexical
from .layout import spread

#: Documents and tokens of a cell at most (a longer document is a cell of its own), and documents of a block.
CELL, CELL_TOKENS, BLOCK = 4096, 2_000_000, 128
#: Folders of each field that terms are dealt to.
BUCKETS = 32
#: Questions, and terms of questions, that are searched at one time. They are sent to every task.
QUERIES, QUERY_TERMS = 20_000, 1_000_000
PACKED = "field string, cell bigint, term string, n bigint, total bigint, places binary, counts binary, docs binary"


def _bucket(term: Column) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def _packed(record: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, record.schema) as out:
        out.write_batch(record)
    return sink.getvalue().to_pybytes()


def _spans(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as byte strings."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, dtype=np.int32))])


def _cell(field: str, cell: int, docs: pa.Table) -> pa.RecordBatch:
    """One cell's rows: documents (key, family, role, tokens) in order of keys; equal keys are one document."""
    key = docs.column("key").combine_chunks()
    fresh = np.ones(len(key), bool)
    fresh[1:] = pc.fill_null(pc.not_equal(key[1:], key[:-1]), True).to_numpy(zero_copy_only=False) & ~(key[1:].is_null().to_numpy(zero_copy_only=False) & key[:-1].is_null().to_numpy(zero_copy_only=False))
    place, first = np.cumsum(fresh) - 1, pa.array(np.flatnonzero(fresh))
    tokens = docs.column("tokens").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    words = pc.list_flatten(tokens).dictionary_encode()
    n = int(fresh.sum())
    lengths = np.bincount(np.repeat(place, sizes), minlength=n).astype(np.int32)
    both, counts = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(place, sizes), return_counts=True) if sizes.sum() else (np.zeros(0, np.int64),) * 2
    code, at = both // max(n, 1), both % max(n, 1)
    edges = np.concatenate([np.flatnonzero(np.diff(code, prepend=-1)), [len(code)]])
    held = code[edges[:-1]]
    order = np.append(edges[:-1], len(code))
    total = np.add.reduceat(counts, order[:-1]) if len(held) else np.zeros(0, np.int64)
    about = pa.RecordBatch.from_arrays([key.take(first), pa.array(lengths), docs.column("family").combine_chunks().take(first), docs.column("role").combine_chunks().take(first)], names=["key", "dl", "family", "role"])
    m = len(held)
    none = pa.array([None], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([field] * (m + 1)), pa.array(np.full(m + 1, cell)), pa.concat_arrays([pa.array([None], pa.string()), words.dictionary.take(pa.array(held)).cast(pa.string())]),
            pa.array(np.concatenate([[n], np.diff(order)]).astype(np.int64)), pa.array(np.concatenate([[int(lengths.sum())], total]).astype(np.int64)),
            pa.concat_arrays([none, _spans(at, order)]), pa.concat_arrays([none, _spans(counts, order)]), pa.concat_arrays([pa.array([_packed(about)], pa.binary()), pa.nulls(m, pa.binary())]),
        ],
        names=["field", "cell", "term", "n", "total", "places", "counts", "docs"],
    )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, equal keys of a field side by side, cut into cells; one of each field is held at a time."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    open_cells: dict[str, tuple[list[pa.RecordBatch], int, int]] = {}
    for mixed in lexical.tokenized(batches):
        for field in pc.unique(mixed.column("field")).to_pylist():
            batch = mixed.filter(pc.equal(mixed.column("field"), field))
            held, docs, tokens = open_cells.get(field, ([], 0, 0))
            keys = batch.column("key")
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().astype(np.int64))
            i = 0
            while i < batch.num_rows:
                if held and (docs >= CELL or tokens >= CELL_TOKENS) and held[-1].column("key")[-1] != keys[i]:
                    yield _cell(field, number, pa.Table.from_batches(held))
                    held, docs, tokens, number = [], 0, 0, number + 1
                before = int(sizes[i - 1]) if i else 0
                room = int(np.searchsorted(sizes, before + max(1, CELL_TOKENS - tokens), "right"))
                j = max(i + 1, min(batch.num_rows, i + max(1, CELL - docs), room))
                held.append(batch.slice(i, j - i))
                docs, tokens, i = docs + j - i, tokens + int(sizes[j - 1]) - before, j
            open_cells[field] = held, docs, tokens
    for field, (held, _, _) in open_cells.items():
        yield _cell(field, number, pa.Table.from_batches(held))
        number += 1


class _Batch:
    """The questions of one batch, by number: terms with their idf, and what their routes admit."""

    def __init__(self, ids: list, terms: list[dict[str, float]], rules: list[tuple | None], k: int | None):
        self.ids, self.terms, self.rules, self.k = ids, terms, rules, k


class _Cell:
    """Postings of one cell as a batch asks for them: weights without idf, with the largest of each block."""

    def __init__(self, docs: pa.RecordBatch, mean: float):
        self.keys = docs.column("key")
        self.n = docs.num_rows
        self.norm = lexical.K1 * (1.0 - lexical.B + lexical.B * docs.column("dl").to_numpy() / mean) if mean else np.ones(self.n)
        self.family, self.role = docs.column("family"), docs.column("role")
        self.blocks = -(-self.n // BLOCK)
        self.held: dict[str, tuple] = {}

    def add(self, term: str, places: bytes, counts: bytes) -> None:
        at, tf = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32)
        weight = tf * (lexical.K1 + 1) / (tf + self.norm[at])
        edges = np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)
        most = np.zeros(self.blocks)
        some = np.flatnonzero(np.diff(edges))
        most[some] = np.maximum.reduceat(weight, edges[some])
        self.held[term] = (at, weight, edges, most)

    def admitted(self, rule: tuple | None) -> np.ndarray | None:
        if rule is None:
            return None
        family, role, by_role = rule
        ok = np.ones(self.n, bool)
        for value, column in ((family, self.family), (role if by_role else None, self.role)):
            if value is not None:
                ok &= pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)
        return ok

    def best(self, terms: dict[str, float], k: int | None, floor: float, admitted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k (and those tied with the k-th, to nine digits), none below `floor`; all without a k."""
        mine = [(idf, *self.held[t]) for t, idf in terms.items() if t in self.held]
        if not mine:
            return np.zeros(0, np.int64), np.zeros(0)
        scores = np.zeros(self.n)

        def read(blocks: np.ndarray) -> None:
            every = len(blocks) * 2 > self.blocks
            wanted = np.zeros(self.blocks, bool)
            wanted[blocks] = True
            for idf, at, weight, edges, _ in mine:
                if len(blocks) == self.blocks:
                    scores[at] += idf * weight
                elif every:
                    some = wanted[at // BLOCK]
                    scores[at[some]] += idf * weight[some]
                else:
                    for b in blocks[edges[blocks + 1] > edges[blocks]].tolist():
                        scores[at[edges[b] : edges[b + 1]]] += idf * weight[edges[b] : edges[b + 1]]

        if k is None:
            read(np.arange(self.blocks))
        else:
            bound = np.sum([idf * most for idf, _, _, _, most in mine], axis=0)
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] >= max(floor, 1e-300)]
            head = order[: max(1, -(-2 * k // BLOCK))]
            read(head)
            seen = scores if admitted is None else np.where(admitted, scores, 0.0)
            if np.count_nonzero(seen) >= k:
                floor = max(floor, float(np.partition(seen, self.n - k)[self.n - k]) - 2e-9)
            rest = order[len(head) :]
            read(rest[bound[rest] >= floor])
        if admitted is not None:
            scores = np.where(admitted, scores, 0.0)
        found = np.flatnonzero((scores > 0) & (scores >= floor))
        if k is not None and len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - 2e-9]
        return found, scores[found]


def _search(batch: _Batch, mean: float, key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of cells, a cell's own row first; the best of each question over all cells of the task."""
    wanted = [(i, t, r) for i, (t, r) in enumerate(zip(batch.terms, batch.rules, strict=True)) if t]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[pa.Array, np.ndarray]] = {}
        floors = np.zeros(len(batch.ids))
        cell, now = None, None

        def out(i: int, keys: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i, np.int32)), keys.cast(key), pa.array(scores)], names=["number", "key", "score"])

        def search() -> Iterator[pa.RecordBatch]:
            rules: dict = {}
            for i, terms, rule in wanted:
                if rule not in rules:
                    rules[rule] = cell.admitted(rule)
                places, scores = cell.best(terms, batch.k, floors[i], rules[rule])
                if not len(places):
                    continue
                keys = cell.keys.take(pa.array(places))
                if batch.k is None:
                    yield out(i, keys, scores)
                    continue
                if i in best:
                    keys, scores = pa.concat_arrays([best[i][0], keys]), np.concatenate([best[i][1], scores])
                if len(scores) >= batch.k:
                    floors[i] = np.partition(scores, len(scores) - batch.k)[len(scores) - batch.k] - 2e-9
                    kept = np.flatnonzero(scores >= floors[i])
                    keys, scores = keys.take(pa.array(kept)), scores[kept]
                best[i] = keys, scores

        for record in rows:
            cells, terms = record.column("cell").to_numpy(), record.column("term")
            places, counts, docs = record.column("places"), record.column("counts"), record.column("docs")
            for r in range(record.num_rows):
                if cells[r] != now:
                    if cell is not None:
                        yield from search()
                    now, cell = cells[r], None
                if (term := terms[r].as_py()) is None:
                    cell = _Cell(pa.ipc.open_stream(docs[r].as_buffer()).read_next_batch(), mean)
                else:
                    cell.add(term, places[r].as_buffer().to_pybytes(), counts[r].as_buffer().to_pybytes())
        if cell is not None:
            yield from search()
        for i, (keys, scores) in best.items():
            yield out(i, keys, scores)

    return run


@dataclass(frozen=True)
class KeywordIndex:
    packed: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str
    path: str

    def _key_type(self) -> T.DataType:
        return T._parse_datatype_string(self.stats.select("key_type").first()[0])

    @property
    def docs(self) -> DataFrame:
        """(field, key, dl), a row a document and field."""
        kind = self._key_type()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for field, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    d = pa.ipc.open_stream(docs.as_buffer()).read_next_batch()
                    yield pa.RecordBatch.from_arrays([pa.array([field] * d.num_rows), d.column("key"), d.column("dl")], names=["field", self_key, "dl"])

        self_key = self.key
        return self.packed.where("bucket = -1").select("field", "docs").mapInArrow(run, T.StructType([T.StructField("field", T.StringType()), T.StructField(self.key, kind), T.StructField("dl", T.IntegerType())]))

    @property
    def postings(self) -> DataFrame:
        """(field, term, cell, n, total): in how many documents of a cell a term is, and how often."""
        return self.packed.where("bucket >= 0").select("field", "term", "cell", "n", "total")

    def _searched(self, queries: DataFrame, k: int | None, field: str, rules: DataFrame | None, text_col: str) -> DataFrame:
        """(query_id, key, score): of each task the best k of each question, or all."""
        spark = queries.sparkSession
        asked = lexical.query_terms(queries, text_col)
        size = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
        batches = max(1, -(-size[0] // QUERY_TERMS), -(-size[1] // QUERIES))
        stats = self.stats.where(F.col("field") == field).select("n_docs", "avgdl", "key_type").first()
        kind = T._parse_datatype_string(stats["key_type"])
        schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("key", kind), T.StructField("score", T.DoubleType())])
        made = []
        for b in range(batches):
            part = asked if batches == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b)
            known = part.withColumn("bucket", _bucket(F.col("term"))).join(self.terms.where(F.col("field") == field), ["bucket", "term"]).select("query_id", "term", "bucket", "df")
            if rules is not None:
                known = known.join(rules.select("query_id", "family", "role", "by_role"), "query_id", "left")
            rows = known.toArrow().to_pydict()
            ids = list(dict.fromkeys(rows["query_id"]))
            number = {q: i for i, q in enumerate(ids)}
            batch = _Batch(ids, [{} for _ in ids], [None] * len(ids), k)
            for r, (q, term, df) in enumerate(zip(rows["query_id"], rows["term"], rows["df"], strict=True)):
                batch.terms[number[q]][term] = float(np.log((stats["n_docs"] - df + 0.5) / (df + 0.5) + 1.0))
                if rules is not None and rows["by_role"][r] is not None:
                    batch.rules[number[q]] = (rows["family"][r], rows["role"][r], rows["by_role"][r])
            own = lambda buckets: self.packed.where((F.col("field") == field) & F.col("bucket").isin(buckets)).select("cell", "term", "places", "counts", "docs")
            terms = spark.createDataFrame(pa.table({"t": pa.array(sorted(set(rows["term"])), pa.string())}))
            read = own([-1]).unionByName(own(sorted(set(rows["bucket"]))).join(F.broadcast(terms), F.col("term") == F.col("t"), "left_semi"))
            names = spark.createDataFrame(pa.table({"number": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids, type=pa.string() if not ids else None)}))
            mean = float(stats["avgdl"])
            found = read.repartition("cell").sortWithinPartitions("cell", "term").mapInArrow(_search(batch, mean, to_arrow_type(kind)), schema)
            found = found.join(F.broadcast(names), "number").select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("key").alias(self.key), "score")
            if batches > 1:  # each batch is done before the next is sent
                at = f"{index.scratch_path(spark, 'search')}/{b}"
                found.write.parquet(at)
                found = spark.read.schema(found.schema).parquet(at)
            made.append(found)
        out = made[0]
        for more in made[1:]:
            out = out.unionByName(more)
        return out

    def scores(self, queries: DataFrame, field: str = "page_content", text_col: str = "question") -> DataFrame:
        """(query_id, key, score) of all chunks that share a term with a query, as lexical.bm25_scores gives them."""
        return self._searched(queries, None, field, None, text_col)

    def top_k(self, queries: DataFrame, k: int = lexical.CANDIDATES, field: str = "page_content", allowed: DataFrame | None = None, rules: DataFrame | None = None, text_col: str = "question") -> DataFrame:
        """(query_id, key, rank, score). Restrictions of the result, not of the statistics: `rules` (query_id, family, role, by_role, as fusion.routes gives them)
        are applied inside the cells; `allowed` (query_id, key) is met by all scored pairs."""
        if allowed is None:
            return lexical.top_k(self._searched(queries, k, field, rules, text_col), k, self.key)
        return lexical.top_k(self.scores(queries, field, text_col).join(allowed, ["query_id", self.key], "left_semi"), k, self.key)

    def refresh(self) -> None:
        """Forgets what is cached of the index; never raises."""
        for table in (self.packed, self.terms, self.stats):
            table.unpersist()


def build(chunks: DataFrame, fields: list[str], path: str, sign: str, key: str = "chunk_id") -> None:
    """Writes the index of the text columns `fields` into a folder of its own under path, signature last.

    A null text has no tokens and counts as a document of length 0; repeated keys are one document. Columns doc_family and doc_role, where
    there are any, go along for routes. Texts are tokenized where they are read and are neither shuffled nor sorted, but for rows that share a key; keys are
    counted by one shuffle, and packed postings are dealt to buckets.
    """
    spark = chunks.sparkSession
    root = index.state(path, sign)
    index.unsign(spark, root)
    mark = lambda c: (F.col(c).cast("string") if c in chunks.columns else F.lit(None).cast("string")).alias(c.removeprefix("doc_"))
    rows = spread(chunks.select(F.col(key).alias("key"), mark("doc_family"), mark("doc_role"), *fields))
    again = index.written(chunks.groupBy(F.col(key).alias("same")).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if not again.isEmpty():  # rows of one key must lie side by side
        marked = rows.join(again, F.col("key").eqNullSafe(F.col("same")), "left")
        rows = marked.where("n is null").select(*rows.columns).unionByName(marked.where("n is not null").select(*rows.columns).repartition("key").sortWithinPartitions("key"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), lexical.lower(name).alias("tokens")) for name in fields]))  # texts until the workers tokenize them
    packed = rows.select("key", "family", "role", each.alias("f")).select("f.field", "key", "family", "role", "f.tokens").mapInArrow(_cells, PACKED).withColumn("bucket", _bucket(F.col("term")))
    packed.hint("rebalance", "field", "bucket").sortWithinPartitions("field", "bucket", "term", "cell").write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{root}/packed")
    stored = _read(spark, f"{root}/packed", PACKED)
    stored.where("bucket >= 0").groupBy("field", "bucket", "term").agg(F.sum("n").alias("df")).write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{root}/terms")
    stats = stored.where("bucket = -1").groupBy("field").agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("avgdl"))
    every = spark.createDataFrame([(f,) for f in fields], "field string").join(F.broadcast(stats), "field", "left")
    every.select("field", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("avgdl", F.lit(0.0)).alias("avgdl"), F.lit(chunks.schema[key].dataType.simpleString()).alias("key_type")).coalesce(1).write.mode("overwrite").parquet(f"{root}/stats")
    index.sign(spark, root, sign)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(path)


def open_keyword_index(spark: SparkSession, path: str, sign: str, key: str = "chunk_id") -> KeywordIndex:
    root = index.state(path, sign)
    if index.stored_signature(spark, root) != sign:
        raise FileNotFoundError(f"no keyword index signed {sign} in {path}")
    return KeywordIndex(_read(spark, f"{root}/packed", PACKED), _read(spark, f"{root}/terms", "term string, df bigint, field string"), spark.read.parquet(f"{root}/stats"), key, root)


def ensure(chunks: DataFrame, fields: list[str], path: str, sign: str, key: str = "chunk_id") -> KeywordIndex:
    """The index in path that is signed alike, else a new one beside those that are there."""
    spark = chunks.sparkSession
    if index.stored_signature(spark, index.state(path, sign)) != sign:
        build(chunks, fields, path, sign, key)
    return open_keyword_index(spark, path, sign, key)


def joined(*indexes: KeywordIndex) -> KeywordIndex:
    """Indexes of different fields of one corpus as one."""
    one = indexes[0]
    for more in indexes[1:]:
        one = KeywordIndex(one.packed.unionByName(more.packed), one.terms.unionByName(more.terms), one.stats.unionByName(more.stats), one.key, one.path)
    return one
