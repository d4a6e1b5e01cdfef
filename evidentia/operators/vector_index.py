"""A stored vector index: cells around centres, searched best first, exact by the triangle inequality.

Vectors lie in the cell of their nearest centre, in blocks ordered by their distance to it; cells are partitions of one table. A row x of a cell with centre c
and distance d has q.x = q.c + q.(x - c) <= q.c + |q| d. A question first reads the few cells with the largest q.c. Then it reads the cells
whose bound reaches its k-th score, and of these only the blocks whose own bound does. Nothing else can be among the first k.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import index, vectors

#: Vectors that a cell should hold; most cells, and numbers in all their centres; rows that centres are fitted on.
CELL, CELLS, NUMBERS, SAMPLE = 256, 1024, 4_000_000, 50_000
#: Rows of a block, and questions that travel together.
BLOCK, SLICE = 512, 256
#: Cells that a question reads first.
FIRST = 2
BLOCKS = "n int, high double, rows binary, cell int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, grp, vec, dist, cell) in order of (cell, dist) as blocks of one cell."""
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            for a in range(i, j, BLOCK):
                rows = batch.slice(a, min(BLOCK, j - a))
                yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int32()), pa.array([rows.column("dist")[-1].as_py()]), pa.array([vectors.pack(rows.select(["key", "grp", "vec"]))], pa.binary()), pa.array([cell[i]], pa.int32())], names=["n", "high", "rows", "cell"])


@dataclass(frozen=True)
class VectorIndex:
    blocks: DataFrame
    cells: DataFrame
    key: str
    key_type: T.DataType
    path: str

    def top_k(self, queries: DataFrame, k: int = 50, digits: int = 9) -> DataFrame:
        """(query_id, key, rank, score) by dot product, as vectors.vector_top_k gives them. queries: query_id, vec, and, if there is one, grp: a row with a grp reads only vectors of that group."""
        return vectors.rank_scored(self.candidates(queries, k, digits)[0], k, self.key, digits)

    def candidates(self, queries: DataFrame, k: int, digits: int = 9) -> tuple[DataFrame, DataFrame]:
        """((query_id, key, score) that hold the first k of each question, (query_id, cell) that were read)."""
        spark = queries.sparkSession
        scratch = index.scratch_path(spark, "vectors")
        known = self.cells.orderBy("cell").toArrow()
        if not len(known):
            return spark.createDataFrame([], T.StructType([queries.schema["query_id"], T.StructField(self.key, self.key_type), T.StructField("score", T.DoubleType())])), queries.select("query_id", F.lit(0).alias("cell")).limit(0)
        cells = {"cell": known.column("cell").to_numpy(), "radius": known.column("radius").to_numpy(), "centre": vectors.matrix(known.column("centre").combine_chunks())}
        grp = F.col("grp").cast("string") if "grp" in queries.columns else F.lit(None).cast("string")
        asked = queries.where("vec is not null").select("query_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"), grp.alias("grp"))
        # the cells read first are written down, so that both turns see the same ones
        marked = T.StructType([*asked.schema.fields, T.StructField("first", T.ArrayType(T.IntegerType()))])
        asked.mapInArrow(_nearest(cells), marked).write.parquet(f"{scratch}/asked")
        asked = spark.read.schema(marked).parquet(f"{scratch}/asked")
        slack = 10.0**-digits
        ids = T.StructField("query_id", queries.schema["query_id"].dataType)
        found = T.StructType([ids, T.StructField(self.key, self.key_type), T.StructField("score", T.DoubleType())])
        sends = "cell int, asked binary"

        def turn(rows: DataFrame, first: bool, name: str) -> tuple[DataFrame, DataFrame]:
            rows.mapInArrow(_choose(cells, first, slack), sends).write.parquet(f"{scratch}/{name}_sent")
            sent = spark.read.schema(sends).parquet(f"{scratch}/{name}_sent")
            made = self.blocks.join(sent, "cell").select("high", "rows", "asked", "cell").mapInArrow(_scan(cells, k, slack, self.key, to_arrow_type(ids.dataType), to_arrow_type(self.key_type)), found)
            vectors.rank_scored(made, k, self.key, digits).drop("rank").write.parquet(f"{scratch}/{name}")
            return spark.read.schema(found).parquet(f"{scratch}/{name}"), sent

        near, read = turn(asked.withColumn("floor", F.lit(-math.inf)), True, "near")
        floor = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-math.inf).alias("floor"))
        rest, more = turn(asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf))), False, "rest")
        return near.unionByName(rest), read.unionByName(more)


def _nearest(cells: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each question the places of the FIRST cells with the largest products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                near = np.argsort(-(vectors.matrix(part.column("vec")) @ cells["centre"].T), axis=1, kind="stable")[:, :FIRST]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "first"])

    return run


def _choose(cells: dict[str, np.ndarray], first: bool, slack: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each cell that some questions read now, with these questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                q = vectors.matrix(part.column("vec"))
                now = np.zeros((len(q), len(cells["cell"])), bool)
                np.put_along_axis(now, vectors.matrix(part.column("first")).astype(np.int64), True, axis=1)
                if not first:
                    reach = q @ cells["centre"].T + np.sqrt((q * q).sum(1))[:, None] * cells["radius"]
                    now = ~now & (reach >= part.column("floor").to_numpy()[:, None] - slack)
                for c in np.flatnonzero(now.any(0)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([cells["cell"][c]], pa.int32()), pa.array([vectors.pack(part.take(pa.array(np.flatnonzero(now[:, c]))))], pa.binary())], names=["cell", "asked"])

    return run


def _scan(cells: dict[str, np.ndarray], k: int, slack: float, key: str, id_type: pa.DataType, key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first k of a block, and those that tie with the k-th, for each question whose bound the block reaches."""
    place = {c: i for i, c in enumerate(cells["cell"].tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = vectors.unpack(batch.column("asked")[i])
                q, floor = vectors.matrix(asked.column("vec")), asked.column("floor").to_numpy()
                centre = cells["centre"][place[batch.column("cell")[i].as_py()]]
                reached = np.flatnonzero(q @ centre + np.sqrt((q * q).sum(1)) * batch.column("high")[i].as_py() >= floor - slack)
                if not len(reached):
                    continue
                rows = vectors.unpack(batch.column("rows")[i])
                scores = q[reached] @ vectors.matrix(rows.column("vec")).T
                of, groups = asked.column("grp").take(pa.array(reached)), rows.column("grp").dictionary_encode()
                mine = pc.fill_null(pc.index_in(of, value_set=groups.dictionary), -1).to_numpy()
                ok = (of.is_null().to_numpy(zero_copy_only=False)[:, None] | (mine[:, None] == pc.fill_null(groups.indices, -2).to_numpy()[None, :])) & (scores >= floor[reached][:, None] - slack)
                many = np.flatnonzero(ok.sum(1) > k)
                if len(many):
                    kept = np.where(ok[many], scores[many], -np.inf)
                    ok[many] &= kept >= np.partition(kept, kept.shape[1] - k, 1)[:, [-k]] - slack
                a, b = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(reached[a])).cast(id_type), rows.column("key").take(pa.array(b)).cast(key_type), pa.array(scores[a, b])], names=["query_id", key, "score"])

    return run


def build(passages: DataFrame, path: str, sign: str, key: str = "chunk_id", vec: str = "vec", group: Column | None = None) -> None:
    """Writes the index of (key, vec) under path, in a folder of its own, signature last. Rows without a vector aren't in it.

    Centres are fitted by Spark's k-means on a sample of about SAMPLE rows by hash of the key; every row is indexed. A cell of any size lies in many blocks and files.
    """
    spark = passages.sparkSession
    root = index.state(path, sign)
    index.unsign(spark, root)
    grp = F.lit(None).cast("string") if group is None else group.cast("string")
    rows = passages.select(F.col(key).alias("key"), grp.alias("grp"), F.transform(vec, lambda x: x.cast("double")).alias("vec")).where("vec is not null and size(vec) > 0")
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    marked = rows.withColumn("features", array_to_vector("vec"))
    cells = max(2, min(CELLS, NUMBERS // (width or 1), -(-n // CELL)))
    if n:
        share = min(1.0, SAMPLE / n)
        sample = marked if share == 1.0 else marked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
        model = KMeans(k=cells, seed=1, maxIter=5, initSteps=1, featuresCol="features", predictionCol="cell").fit(sample)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        placed = model.transform(marked).drop("features")
    else:
        centres, placed = [], rows.withColumn("cell", F.lit(0))
    about = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    away = placed.join(F.broadcast(about), "cell")
    dist = F.sqrt(F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    dealt = away.select("key", "grp", "vec", dist.alias("dist"), "cell").hint("rebalance", "cell").sortWithinPartitions("cell", "dist")
    dealt.mapInArrow(_blocks, BLOCKS).write.mode("overwrite").partitionBy("cell").parquet(f"{root}/blocks")
    stored = spark.read.schema(BLOCKS).parquet(f"{root}/blocks")
    sizes = stored.groupBy("cell").agg(F.sum("n").alias("n"), F.max("high").alias("radius"))
    about.join(sizes, "cell").write.mode("overwrite").parquet(f"{root}/cells")
    index.sign(spark, root, sign)


def ensure(passages: DataFrame, path: str, sign: str, key: str = "chunk_id", vec: str = "vec", group: Column | None = None) -> VectorIndex:
    """The index in path that is signed alike, else a new one beside those that are there."""
    spark, root = passages.sparkSession, index.state(path, sign)
    if index.stored_signature(spark, root) != sign:
        build(passages, path, sign, key, vec, group)
    cells = "cell int, centre array<double>, n bigint, radius double"
    return VectorIndex(spark.read.schema(BLOCKS).parquet(f"{root}/blocks"), spark.read.schema(cells).parquet(f"{root}/cells"), key, passages.schema[key].dataType, root)
