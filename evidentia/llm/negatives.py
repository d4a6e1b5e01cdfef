"""Hard negatives by one-dimensional distance keys: vectors stored by (pivot, distance), key intervals scanned outwards until the bound certifies the top k.

Every vector x gets one more component, sqrt(M^2 - |x|^2), M the largest length; an anchor q gets a zero. Then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the highest inner products are the nearest neighbours.
A row's key is its nearest pivot and its distance to that. By the triangle inequality a row with key (p, r) is no nearer to q'
than |d(q', p) - r|: an interval of keys whose bound lies beyond the k-th row found needs no scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._blocks import pack
from ._scratch import Scratch

#: Rows that pivots are fitted on, and numbers in them, at most. Every row is indexed.
SAMPLE, SAMPLE_NUMBERS = 8192, 4_000_000
#: Most pivots, and parts that labels are dealt to, so that a search within a label reads one part.
PIVOTS, PARTS = 64, 16
#: Rows of a page, and numbers in it. A segment is a run of pages; so many segments at most, besides the last of each pivot and task.
PAGE, PAGE_NUMBERS, SEGMENTS = 1024, 1 << 20, 65_536
#: Nearest segments in the first round of a search, and how many times more in each next one.
FIRST, GROWTH = 8, 8
#: Anchors that travel together.
SLICE = 256
LEAST, MOST = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)


def _matrix(rows: pa.Array, width: int | None = None) -> np.ndarray:
    """Byte strings as rows of doubles, shorter ones followed by zeros, cut at a width if one is given."""
    data, offsets = B.flat(rows)
    numbers, size = np.frombuffer(data.tobytes()), np.diff(offsets) // 8
    width = int(size.max(initial=0)) if width is None else width
    if (size == width).all():
        return numbers.reshape(len(size), width)
    out = np.zeros((len(size), width))
    at = np.concatenate([[0], np.cumsum(size)])
    for i, n in enumerate(np.minimum(size, width).tolist()):
        out[i, :n] = numbers[at[i] : at[i] + n]
    return out


def _ready(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows that take part, components as floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, labels, anchor = batch.columns
            keep, packed, norm = [], [], []
            some = pc.and_(pc.and_(ids.is_valid(), labels.is_valid()), vectors.is_valid()).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(some).tolist():
                part = vectors[i].values
                if part.null_count:
                    continue
                with np.errstate(all="ignore"):
                    x = np.floor(part.to_numpy(zero_copy_only=False).astype(np.float64) * scale) + 0.0
                    n = float(x @ x)
                if not np.isfinite(n):
                    continue
                keep.append(i)
                packed.append(x.tobytes())
                norm.append(n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), anchor.take(at), pa.array(packed, pa.binary()), pa.array(norm, pa.float64())], names=["vec_id", "label", "anchor", "vec", "norm"])

    return run


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    c = x[np.random.default_rng(5).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        sums, size = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


class Keys:
    """Pivots of augmented vectors, and distances to them."""

    def __init__(self, sample: np.ndarray, norm: np.ndarray, top: float, k: int):
        self.top = top
        self.pivots = _kmeans(np.column_stack([sample, np.sqrt(np.maximum(0.0, top - norm))]), k) if len(sample) else np.zeros((1, 1))
        self.width = self.pivots.shape[1] - 1
        self.squares = (self.pivots * self.pivots).sum(1)

    def _distances(self, x: np.ndarray, own: np.ndarray | float, square: np.ndarray) -> np.ndarray:
        part = x[:, : self.width]
        dots = part @ self.pivots[:, : part.shape[1]].T + np.reshape(own, (-1, 1)) * self.pivots[:, -1]
        return np.sqrt(np.maximum(0.0, square[:, None] + self.squares - 2 * dots))

    def of_rows(self, x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(x, np.sqrt(np.maximum(0.0, self.top - norm)), np.full(len(x), self.top))
        near = d.argmin(1)
        return near, d[np.arange(len(x)), near]

    def of_anchors(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return self._distances(x, np.zeros(len(x)), norm)


def _keyed(keys: Keys) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, dist = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows)
            norm = batch.column("norm").to_numpy()
            for i in range(0, batch.num_rows, 1024):
                x = _matrix(batch.column("vec").slice(i, 1024), keys.width)
                near[i : i + 1024], dist[i : i + 1024] = keys.of_rows(x, norm[i : i + 1024])
            yield pa.RecordBatch.from_arrays([*batch.select(["part", "vec_id", "label", "vec"]).columns, pa.array(near), pa.array(dist)], names=["part", "vec_id", "label", "vec", "pivot", "dist"])

    return run


def _anchored(keys: Keys) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors with their distances to all pivots, kept so that each turn sees the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                cut = batch.slice(i, 1024)
                d = keys.of_anchors(_matrix(cut.column("vec"), keys.width), cut.column("norm").to_numpy())
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), pa.array([r.tobytes() for r in d], pa.binary())], names=[*cut.schema.names, "pivot", "dist", "away"])

    return run


def _pages(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows as pages of one part and pivot, in segments of about `span` rows. Inside a page rows are in order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg, held, now = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for batch in batches:
            part, pivot, dist = (batch.column(c).to_numpy() for c in ("part", "pivot", "dist"))
            size = np.diff(B.flat(batch.column("vec"))[1]) // 8
            edge = np.flatnonzero((part[1:] != part[:-1]) | (pivot[1:] != pivot[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                while i < j:
                    wide = np.maximum.accumulate(size[i : min(j, i + PAGE)]) * np.arange(1, min(j, i + PAGE) - i + 1)
                    to = i + max(1, int(np.searchsorted(wide, PAGE_NUMBERS, "right")))
                    if (part[i], pivot[i]) != now or held >= span:
                        seg, held, now = seg + 1, 0, (part[i], pivot[i])
                    held += to - i
                    rows = batch.slice(i, to - i).select(["vec_id", "label", "vec"])
                    rows = rows.take(pa.array(np.argsort(rows.column(0).to_numpy(), kind="stable")))
                    yield pa.RecordBatch.from_arrays([pa.array([seg]), pa.array([part[i]]), pa.array([pivot[i]]), pa.array([float(dist[i])]), pa.array([float(dist[to - 1])]), pa.array([pack(rows)], pa.binary())], names=["seg", "part", "pivot", "low", "high", "rows"])
                    i = to

    return run


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond the range of a long they end at its ends."""
    width = min(a.shape[1], x.shape[1])
    a, x = a[:, :width], x[:, :width]
    if math.sqrt((a * a).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0)) < 2**53:
        return (a @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a).dot(whole(x).T), LEAST, MOST).astype(np.int64)


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of longs of one length as rows."""
    return np.array(column.to_pylist(), dtype=np.int64).reshape(len(column), -1)


def _choose(table: dict[str, np.ndarray], top: float, turn: int, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each segment that anchors still have to scan this turn, one row with these anchors.

    Turn t reaches as far as an anchor's FIRST * GROWTH^t nearest segments do, or as far as its k-th rows found so far ask for, if that is less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                cut = batch.slice(i, SLICE)
                norm, lows, highs, floors, found = cut.column("norm").to_numpy(), _lists(cut.column("lows")), _lists(cut.column("highs")), _lists(cut.column("floors")), _lists(cut.column("found"))
                away = _matrix(cut.column("away"))
                least = np.where(found >= k, np.maximum(floors, lows), lows).min(1)
                base = norm + top
                slack = 1e-9 * base
                need = np.where(least == LEAST, np.inf, base - 2.0 * least + slack)
                part = cut.column("part").to_numpy()
                wanted = np.zeros((cut.num_rows, len(table["seg"])), bool)
                for r in range(cut.num_rows):
                    d = away[r][table["pivot"]]
                    near = np.maximum(0.0, np.maximum(d - table["high"], table["low"] - d)) ** 2
                    near = np.where(np.isfinite(near), near, 0.0)
                    open_ = table["part"] == part[r] if same else (base[r] - (d + table["high"]) ** 2) / 2 <= float(highs[r].max()) + slack[r]
                    bounds = np.sort(near[open_])
                    reach = [bounds[m - 1] if m <= len(bounds) else np.inf for m in (FIRST * GROWTH ** (turn - 1), FIRST * GROWTH**turn)] if turn else [-1.0, bounds[FIRST - 1] if len(bounds) >= FIRST else np.inf]
                    wanted[r] = open_ & (near > reach[0]) & (near <= min(reach[1], need[r]))
                plain = cut.select(["rid", "vec_id", "label", "vec", "lows", "highs", "floors"])
                for s in np.flatnonzero(wanted.any(0)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([table["seg"][s]]), pa.array([pack(plain.take(pa.array(np.flatnonzero(wanted[:, s]))))], pa.binary())], names=["seg", "anchors"])

    return run


def _scan(k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best k rows of a page, and those that tie with the k-th, for each anchor and band."""

    def opened(packed: pa.Scalar) -> pa.RecordBatch:
        return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, page, x, codes, names = None, None, None, None, None
            for i in range(batch.num_rows):
                if (here := batch.column("rows")[i].as_buffer().to_pybytes()) != last:
                    last, page = here, opened(batch.column("rows")[i])
                    x, of = _matrix(page.column("vec")), page.column("label").dictionary_encode()
                    codes, names = of.indices.to_numpy(), of.dictionary
                q = opened(batch.column("anchors")[i])
                scores = _scores(_matrix(q.column("vec")), x)
                mine = pc.fill_null(pc.index_in(q.column("label"), value_set=names), -1).to_numpy()
                ids = page.column("vec_id").to_numpy()
                usable = ((codes[None, :] == mine[:, None]) == same) & (ids[None, :] != q.column("vec_id").to_numpy()[:, None])
                lows, highs = np.maximum(_lists(q.column("lows")), _lists(q.column("floors"))), _lists(q.column("highs"))
                rid = q.column("rid").to_numpy()
                for b in range(lows.shape[1]):
                    ok = usable & (scores >= lows[:, b, None]) & (scores <= highs[:, b, None])
                    many = np.flatnonzero(ok.sum(1) > k)
                    if len(many):
                        kept = np.where(ok[many], scores[many], LEAST)
                        ok[many] &= kept >= np.partition(kept, kept.shape[1] - k, 1)[:, [-k]]
                    a, at = np.nonzero(ok)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(np.full(len(a), b, np.int32)), pa.array(ids[at]), pa.array(scores[a, at])], names=["rid", "band", "vec_id", "score"])

    return run


_FOUND = "rid bigint, band int, vec_id bigint, score bigint"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rid", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(anchors: DataFrame, bands: int, pages: DataFrame, table: dict[str, np.ndarray], k: int, same: bool, top: float, scratch: Scratch, name: str) -> DataFrame:
    """(rid, band, vec_id, score, rank): of each anchor's bands [lows, highs] of scores the first k rows, of its own label or of others."""
    best, turn = None, 0
    while True:
        if best is None:
            state = anchors.withColumns({"found": F.array(*[F.lit(0).cast("bigint")] * bands), "floors": F.array(*[F.lit(LEAST)] * bands)})
        else:
            seen = best.groupBy("rid").agg(*[F.count_if(F.col("band") == b).alias(f"n{b}") for b in range(bands)], *[F.min(F.when(F.col("band") == b, F.col("score"))).alias(f"f{b}") for b in range(bands)])
            known = anchors.join(seen, "rid", "left")
            state = known.withColumns({"found": F.array(*[F.coalesce(f"n{b}", F.lit(0)) for b in range(bands)]), "floors": F.array(*[F.when(F.col(f"n{b}") >= k, F.col(f"f{b}")).otherwise(LEAST) for b in range(bands)])})
        # neighbours travel together
        state = state.sortWithinPartitions("part", "pivot", "dist").select("rid", "vec_id", "label", "vec", "norm", "part", "away", "lows", "highs", "found", "floors")
        sent = scratch.table(f"{name}_sent{turn}", state.mapInArrow(B.tidy(_choose(table, top, turn, k, same)), "seg bigint, anchors binary"))
        if sent.isEmpty():
            return scratch.spark.createDataFrame([], _FOUND + ", rank int") if best is None else best
        found = pages.select("seg", "rows").join(sent, "seg").select("rows", "anchors").mapInArrow(B.tidy(_scan(k, same)), _FOUND)
        best = scratch.table(f"{name}_best{turn}", _best(found if best is None else best.drop("rank").unionByName(found), k))
        turn += 1


def hard_negatives(vectors: DataFrame, *, anchor: Column, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per anchor, positive and hard negative: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the inner product of such whole numbers, and higher scores come first, ties by smaller
    id. Anchors are the rows for which the column `anchor` is true. An anchor's positives are its first rows of the same label, its
    negatives for one of them the first rows of other labels with band[0] % <= negative_score / positive_score <= band[1] %, multiplied out.
    Exact, whatever the vectors are.

    Rows with a null id, label or vector, a null or non-finite component, or one whose scaled square isn't finite in a double take no part.
    A vector shorter than another counts as followed by zeros; an empty one scores 0. Rows equal in id, label and vector count
    once; rows that only share an id are rows of their own, and none is a positive or negative of its own id. Scores beyond a long end at its ends. An
    anchor without positives, or a positive without negatives in its band, gives no rows. Other columns are ignored.

    At scale: rows equal in label and vector tie, so only the first few ids of each such group can be in any top k; these are
    indexed, at their key, and a group of copies of any size is cut down before its shuffle. Pages of the index are dealt in ranges of (part, pivot, distance, id). What is
    collected: a sample bounded by SAMPLE rows for the pivots, and the key intervals of at most about SEGMENTS segments. Each turn sends anchors to the segments
    that they reach and joins them to their pages; work is at most anchors times rows, in blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    schema = "vec_id bigint, label string, anchor boolean, vec binary, norm double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor")).select("vec_id", "v", "label", "anchor")
    ready = scratch.table("ready", rows.mapInArrow(B.tidy(_ready(scale)), schema)).withColumn("part", F.pmod(F.crc32(F.col("label").cast("binary")), F.lit(PARTS)).cast("int"))
    n, top, width = ready.agg(F.count("*"), F.max("norm"), F.max(F.length("vec") / 8)).first()
    top, width = top or 0.0, int(width or 0)
    sample = ready.select("vec_id", "vec", "norm").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // max(1, width)))).toArrow().combine_chunks()
    drawn = sample.column("vec").combine_chunks() if len(sample) else pa.array([], pa.binary())
    keys = Keys(_matrix(drawn), sample.column("norm").to_numpy(), top, min(PIVOTS, max(2, math.isqrt(n) // 16)))

    copy = F.dense_rank().over(Window.partitionBy("label", "vec").orderBy("vec_id"))
    own = ready.withColumn("copy", copy).where(F.col("copy") <= max(positives, negatives) + 1).dropDuplicates(["label", "vec", "vec_id"])
    keyed = own.select("part", "vec_id", "label", "vec", "norm").mapInArrow(B.tidy(_keyed(keys)), "part int, vec_id bigint, label string, vec binary, pivot int, dist double")
    order = ["part", "pivot", "dist", "vec_id"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paged = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(B.tidy(_pages(max(PAGE, -(-n // SEGMENTS)))), "seg bigint, part int, pivot int, low double, high double, rows binary")
    pages = scratch.table("pages", paged)
    spans = pages.groupBy("seg", "part", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    table = {c: spans.column(c).to_numpy() for c in spans.column_names}

    asked = ready.where("anchor").select("part", "vec_id", "label", "vec", "norm").distinct().mapInArrow(B.tidy(_anchored(keys)), "part int, vec_id bigint, label string, vec binary, norm double, pivot int, dist double, away binary")
    anchors = scratch.table("anchors", asked.withColumn("rid", F.monotonically_increasing_id()))
    whole = anchors.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    near = _search(whole, 1, pages, table, positives, True, top, scratch, "positives").select("rid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("band"))

    exact = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(exact * band[0] / 100).cast("bigint"), F.floor(exact * band[1] / 100).cast("bigint")
    side = lambda value, none: F.array(*[F.coalesce(F.max(F.when(F.col("band") == b, value)), F.lit(none)) for b in range(positives)])
    limits = near.groupBy("rid").agg(side(low, MOST).alias("lows"), side(high, LEAST).alias("highs"))
    hard = _search(scratch.table("banded", anchors.join(limits, "rid")), positives, pages, table, negatives, False, top, scratch, "negatives")
    out = hard.join(near, ["rid", "band"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives(rows.withColumn("label", label), anchor=F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""
