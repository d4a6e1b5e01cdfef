"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one kept row a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._components import components
from ._scratch import Scratch

#: Vectors that a cell should hold: ROOT times the square root of the label's, CELL at most. So labels of a few dozen have cells too.
ROOT, CELL = 6, 2048
#: Rows on each side of one product.
BLOCK = 2048
#: Numbers (vectors times dimensions) in the sample that centres are fitted on.
SAMPLE = 4_000_000
#: Centres in all; the largest labels get them, in proportion. Beyond FLAT centres a label's are fitted in two levels.
CENTRES, FLAT = 2048, 64
_READY = "vec_id bigint, class string, d1 bigint, d2 bigint, vec binary"


def _digests(x: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each row's bits."""
    out = []
    for salt in (1, 2):
        place = B.mix(np.arange(x.shape[1], dtype=np.uint64) * B._MULT + np.uint64(salt << 40))
        out.append(B.mix(B.mix(x.view(np.uint64) ^ place).sum(1, dtype=np.uint64)))
    return out


def _rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as byte strings."""
    n, size = len(x), x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(packed: pa.Array) -> np.ndarray:
    """Byte strings of equal length as rows of doubles."""
    data, offsets = B.flat(packed)
    return np.frombuffer(data.tobytes()).reshape(len(packed), -1) if len(data) else np.zeros((len(packed), 0))


def _ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision of rows that can link; class: label and dimension."""
    for batch in batches:
        vectors = batch.column(1)
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(vectors)
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        numbers = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(size)])
        good = (size > 0) & (np.diff(holes[at]) == 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        ids, labels = batch.column(0), batch.column(2)
        for dim in np.unique(size[good]).tolist():
            rows = np.flatnonzero(good & (size == dim))
            x = numbers[at[rows, None] + np.arange(dim)]
            with np.errstate(all="ignore"):
                top = np.abs(x).max(1)
                usable = np.isfinite(x).all(1) & (top > 0)
                x, rows = x[usable], rows[usable]
                unit = x / top[usable, None]
                unit /= np.linalg.norm(unit, axis=1)[:, None]
            d1, d2 = _digests(np.ascontiguousarray(x))
            picked = pa.array(rows)
            name = pc.binary_join_element_wise(labels.take(picked), pa.scalar(str(dim)), "|")
            yield pa.RecordBatch.from_arrays([ids.take(picked), name, pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _rows(unit)], names=["vec_id", "class", "d1", "d2", "vec"])


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the cosine to it, a slice of rows at a time."""
    near, dot = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        dots = x[i : i + 4096] @ c.T
        near[i : i + 4096], dot[i : i + 4096] = dots.argmax(1), dots.max(1)
    return near, dot


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centres of unit rows; a centre that loses all its rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near, dot = _nearest(x, c)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        norm = np.linalg.norm(new, axis=1)
        for j in np.flatnonzero(norm < 1e-9):
            far = int(dot.argmin())
            new[j], norm[j], dot[far] = x[far], 1.0, 1.0
        c = new / norm[:, None]
    return c


def centres_of(x: np.ndarray, k: int) -> np.ndarray:
    """k centres, of many in two levels: a few first, then each one's share among its own rows."""
    if k <= FLAT:
        return spherical_kmeans(x, k)
    first = spherical_kmeans(x, math.isqrt(k))
    near, _ = _nearest(x, first)
    own = [x[near == j] for j in range(len(first))]
    return np.concatenate([spherical_kmeans(o, min(len(o), max(1, round(k * len(o) / len(x))))) for o in own if len(o)])


def _centres(reps: DataFrame) -> dict[str, np.ndarray]:
    """Centres of the classes that need several cells, all fitted on one sample by hash of the id."""
    own = F.ceil(F.col("n") / F.least(F.lit(float(CELL)), ROOT * F.sqrt("n")))
    sizes = reps.groupBy("class").agg(F.count("*").alias("n"), F.first(F.length("vec")).alias("b")).withColumn("k", own).where("k > 1").orderBy(F.desc("n"), "class").limit(CENTRES // 2).collect()
    if not sizes:
        return {}
    total = sum(r["n"] for r in sizes)
    wanted = {r["class"]: min(r["k"], max(2, CENTRES * r["n"] // total)) for r in sizes}
    most = {r["class"]: max(wanted[r["class"]], SAMPLE * 8 * r["n"] // total // r["b"]) for r in sizes}
    shares = reps.sparkSession.createDataFrame([(r["class"], int((1 << 20) * min(1.0, most[r["class"]] / r["n"]))) for r in sizes], "class string, share int")
    # the sample follows the hash, so it is of the wanted size but for chance, and the same each time
    got = reps.join(F.broadcast(shares), "class").where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < F.col("share")).select("class", "rep", "vec").toArrow().sort_by([("class", "ascending"), ("rep", "ascending")]).combine_chunks()
    names, out = got.column("class").to_numpy(), {}
    for name, k in wanted.items():
        x = _matrix(got.column("vec").filter(pa.array(names == name)).combine_chunks())
        if len(x) > k:
            out[name] = centres_of(x, k)
    return out


def _assigner(centres: dict[str, np.ndarray], reach: float):
    """Rows for each cell: at home in the nearest, a guest wherever a vector within `reach` (a distance) may be at home.

    If y, at home in j, is within reach of x, at home in i, then y.cj >= y.ci, so
    x.ci - x.cj <= (x - y).(ci - cj) <= reach * |ci - cj|, whatever the data: no link is missed at a border.
    """
    schema = pa.schema([("class", pa.string()), ("cell", pa.int32()), ("home", pa.bool_()), ("rep", pa.int64()), ("vec", pa.binary()), ("copies", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, names, vecs, copies = batch.columns
            kinds = np.array(names.to_pylist(), dtype=object)
            for name in dict.fromkeys(kinds.tolist()):
                rows = np.flatnonzero(kinds == name)
                for k in range(0, len(rows), 1024):
                    part = rows[k : k + 1024]
                    if name in centres:
                        c = centres[name]
                        dots = _matrix(vecs.take(pa.array(part))) @ c.T
                        home = dots.argmax(1)
                        gap = reach * np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T))) + 1e-6
                        which, cell = np.nonzero(dots[np.arange(len(part)), home][:, None] - dots <= gap)
                        at_home = cell == home[which]
                    else:
                        which, cell, at_home = np.arange(len(part)), np.zeros(len(part), np.int64), np.ones(len(part), bool)
                    picked = pa.array(part[which])
                    yield pa.RecordBatch.from_arrays([names.take(picked), pa.array(cell.astype(np.int32)), pa.array(at_home), reps.take(picked), vecs.take(picked), copies.take(picked)], schema=schema)

    return assign


def _products(threshold: float):
    def multiply(table: pa.Table) -> pa.Table:
        side = table.column("block").to_numpy()
        left = table.column("x")[0].as_py()
        a, b = np.flatnonzero(side == left), np.flatnonzero(side != left)
        same = table.column("y")[0].as_py() == left
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        vec = _matrix(table.column("vec").combine_chunks())
        none = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(a) or not (same or len(b)):
            return none
        x = vec[a]
        if same:
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            counts, rows, cols = linked @ copies[a], a, a
        else:
            linked = x @ vec[b].T >= threshold
            rows, cols = a, b
            counts = np.concatenate([linked @ copies[b], linked.T @ copies[a]])
        # smallest id reachable inside this product
        r, c = ids[rows].copy(), ids[cols].copy()
        while True:
            top = np.iinfo(np.int64).max
            r2 = np.minimum(r, np.where(linked, c[None, :], top).min(1))
            c2 = np.minimum(c, np.where(linked, r2[:, None], top).min(0)) if not same else r2
            if (r2 == r).all() and (c2 == c).all():
                break
            r, c = r2, c2
        every, root = (a, r) if same else (np.concatenate([a, b]), np.concatenate([r, c]))
        if not same and bool(table.column("guests")[0].as_py()):
            counts[len(a) :] = 0  # a guest's links are counted where it is at home
        hit = (counts > 0) | (root != ids[every])
        return pa.table({"rep": pa.array(ids[every][hit]), "links": pa.array(counts[hit].astype(np.int64)), "root": pa.array(root[hit])})

    return multiply


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept (component_id is its own id).

    Rows with equal labels, not null, are linked when their cosine in double precision
    is `threshold` or more.  Vectors that are null, empty, zero or hold null or non-finite
    components, rows with a null label, and vectors of different length link with nothing.
    A null id links with nothing, has a null component_id and is kept. Repeated rows of one id count as links
    of one another.  Other columns are ignored.

    At scale: equal vectors go on as one, with their count.  Centres are fitted on a
    sample bounded by SAMPLE; every row is indexed.  A row is compared in its own cell and in all cells that a linked vector may
    be at home in, by a bound that holds for all data, so none is missed.  A cell is dealt into
    blocks, each two of which meet in a task of their own and return counts and a forest; a cell of any size
    fits.  Data without cell structure make every row a guest in many cells: then the work is that of all pairs in blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    ready = scratch.table("ready", rows.mapInArrow(B.tidy(_ready), _READY))
    groups = scratch.table("groups", ready.groupBy("class", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    own = ready.join(groups, ["class", "d1", "d2"]).where("vec_id = rep").select("rep", "class", "vec", "copies").dropDuplicates(["rep", "class", "vec"])
    reps = scratch.table("reps", own)
    centres = _centres(reps)
    cells = scratch.table("cells", reps.mapInArrow(B.tidy(_assigner(centres, float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6)), "class string, cell int, home boolean, rep bigint, vec binary, copies bigint"))
    size = cells.groupBy("class", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("bh"), F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("bg")).where("bh > 0")
    size = scratch.table("size", size)
    dealt = cells.join(size, ["class", "cell"])
    block = F.pmod(F.xxhash64("rep", F.lit(5)), F.when(F.col("home"), F.col("bh")).otherwise(F.col("bg"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("home"), block).otherwise(-1 - block))
    others = F.when(~F.col("home"), F.sequence(F.lit(0), F.col("bh") - 1)).when(F.col("bg") > 0, F.concat(F.sequence(F.lit(0), F.col("bh") - 1), F.sequence(-F.col("bg"), F.lit(-1)))).otherwise(F.sequence(F.lit(0), F.col("bh") - 1))
    # x is a block of those at home; y another, or one of guests
    tasks = dealt.withColumn("o", F.explode(others)).select("class", "cell", "rep", "vec", "copies", "block", F.when(F.least("block", "o") < 0, F.greatest("block", "o")).otherwise(F.least("block", "o")).alias("x"), F.when(F.least("block", "o") < 0, F.least("block", "o")).otherwise(F.greatest("block", "o")).alias("y"))
    tasks = tasks.withColumn("guests", F.col("y") < 0)
    found = scratch.table("found", tasks.groupBy("class", "cell", "x", "y").applyInArrow(_products(threshold), "rep bigint, links bigint, root bigint"))
    label = components(found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = groups.join(links, "rep", "left").join(label, F.col("rep") == F.col("node"), "left").select("class", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    known = scratch.table("known", ready.join(whole, ["class", "d1", "d2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    out = rows.select("vec_id").join(known, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, m.root AS component_id, m.root = vec_id AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) m ON m.node = e.vec_id
"""
