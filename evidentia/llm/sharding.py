"""A uniform shuffle into shards of exact sizes.

A random permutation that is cut into shards gives each input partition a count in each
shard; together these counts follow a matrix hypergeometric law.  Drawing that
matrix first (a few thousand numbers, on the driver) lets the rest run without talk: each partition
permutes its rows and deals them by its row of the matrix, shards receive them and permute once more.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Rows of an input partition, about, and most of them: the matrix stays small at any size.
ROWS, PARTS = 250_000, 4096


def draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """Hypergeometric; above a thousand million by the ratio of uniforms on log factorials, exact up to their precision."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, taken)) if taken and good else 0
    total = good + bad
    lo, hi = max(0, taken - bad), min(good, taken)
    mean = taken * good / total
    spread = math.sqrt(max(mean * (bad / total) * (total - taken) / max(total - 1, 1), 1e-9) + 0.5)
    lf = lambda n: math.lgamma(n + 1)
    log_p = lambda k: -lf(k) - lf(good - k) - lf(taken - k) - lf(bad - taken + k)
    mode = min(max(int((taken + 1) * (good + 1) / (total + 2)), lo), hi)
    top, width = log_p(mode), 2 * 1.7155277699214135 * spread + 2 * 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / max(u, 1e-300))
        if lo <= k <= hi and 2 * math.log(max(u, 1e-300)) <= log_p(k) - top:
            return k


def matrix(rows: list[int], cols: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, drawn with the probability that a uniform permutation gives them."""
    rng = np.random.default_rng(seed)
    left = list(cols)
    out = []
    for n in rows:
        rest, line = sum(left), []
        for j, c in enumerate(left):
            k = draw(rng, c, rest - c, n) if rest > c else n
            line.append(k)
            rest -= c
            n -= k
            left[j] -= k
        out.append(line)
    return out


def shards(docs: DataFrame, n: int, *, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Shards differ by one row at most; which rows share a shard, and their order (slot, from 0 in each), is a uniform permutation, driven by a seed and
    hashes of the rows.  A null text has no bytes and the checksum of an empty one; rows with a null id are dealt like others;
    repeated rows with an id hash alike, so they start in one partition, and are told apart by their place in it; without one they are spread.
    Other columns are ignored.  Rows with equal texts are dealt independently of each other.

    At scale: what moves is ids, sizes and checksums, twice.  No window spans a shard: its rows are
    ordered in ranges of the hash, whose counts are summed up first.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("bigint").alias("size"), crc.alias("text_crc32"))
    # rows without an id would all hash alike where texts are equal: these are told apart by where they are read
    rows = scratch.table("rows", rows.withColumn("at", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    total = rows.count()
    parts = min(PARTS, max(16, math.ceil(total / ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "at", F.lit(seed)), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    want = [total // n + (s < total % n) for s in range(n)]
    drawn = matrix([counts.get(p, 0) for p in range(parts)], want, seed)
    ends = F.from_json(F.lit(json.dumps(np.cumsum(np.array(drawn, dtype=np.int64).reshape(parts, n), axis=1).tolist())), "array<array<bigint>>")
    local = Window.partitionBy("part").orderBy(F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed + 1)), "doc_id")
    dealt = rows.withColumn("i", F.row_number().over(local) - 1).withColumn("shard", F.size(F.filter(F.element_at(ends, F.col("part") + 1), lambda e: e <= F.col("i"))))
    ranges = max(1, math.ceil(total / n / ROWS))
    order = F.xxhash64("doc_id", "text_crc32", "i", "part", F.lit(seed + 2))
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", order.alias("v"), (F.pmod(F.shiftright(order, 20), F.lit(ranges))).cast("int").alias("range"))
    dealt = scratch.table("dealt", dealt)
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "range").orderBy("v", "doc_id")
    placed = dealt.withColumn("k", F.row_number().over(within)).join(base, ["shard", "range"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("k") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
