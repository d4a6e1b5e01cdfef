"""Mixing sources to target weights: hash-random order, distributed prefix sums of sizes, an exact cut at each source's budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import Scratch

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows their task's number and the sum of the sizes before them in this task, anew for each group."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    now, total = None, 0
    for batch in batches:
        group, size = batch.column("grp").to_numpy(), batch.column("size").to_numpy()
        if not len(group):
            continue
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.cumsum(size) - size
        carried = np.zeros(len(first), np.int64)
        carried[0] = total if group[0] == now else 0
        start = before - np.repeat(before[first] - carried, np.diff(np.append(first, len(group))))
        now, total = group[-1], int(start[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(group), part, np.int32)), pa.array(start)], names=[*batch.schema.names, "part", "local"])


def prefix_sums(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """rows (grp, size, ...) with `start`, the sum of the sizes of the rows of their group that come before them in this order, which begins with grp.

    Rows are dealt in ranges of the order, so a group of any size lies in as many tasks as it needs. Each task sums its own
    rows; only one sum for each task and group travels after that.
    """
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    local = scratch.table(name, ranged.mapInArrow(B.tidy(_running), f"{schema}, part int, local bigint"))
    sums = local.groupBy("grp", "part").agg(F.max(F.col("local") + F.col("size")).alias("sum"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(f"{name}_offsets", sums.withColumn("offset", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).select("grp", "part", "offset"))
    return local.join(offsets, ["grp", "part"]).withColumn("start", F.col("local") + F.col("offset")).drop("part", "local", "offset")


def targets(sources: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """sources (source, source_size) with grp (their place by code point from 0, null last), weight and target (words, a double).

    The weights repeat along that order. All sources share `share` of all words by weight; one that would get more than `most`
    times its own words gets that much, and the excess is shared anew among the others until none is above.
    """
    ones = sources.select(F.col("source").isNull().cast("bigint").alias("grp"), F.lit(1).cast("bigint").alias("size"), "source", "source_size")
    placed = prefix_sums(ones, [F.col("grp"), F.col("source")], scratch, "places")
    named = sources.where("source is not null").count()
    grp = F.col("start") + F.when(F.col("source").isNull(), named).otherwise(0)
    ranked = placed.select("source", "source_size", grp.alias("grp"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("grp") % len(weights) + 1).cast("int")).cast("bigint"))
    ranked = scratch.table("ranked", ranked)
    # the level rises each time that a source stops at its cap; one row comes to the driver each time
    level, done = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > F.col("source_size") * most
        total, stopped, weight, n = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == done or not total or not weight:
            break
        done, level = n, (total * share - (stopped or 0)) / weight
    reached = F.lit(level) * F.col("weight")
    cap = (F.col("source_size") * most).cast("double")
    return ranked.withColumn("target", F.when(reached > cap, cap).otherwise(reached))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """One row per input row: id, size (words), source_size (of its source), target (of its source, words), taken (words that the mix takes of it, repeats counted).

    A source gives all its documents as often as its target holds them whole. For what is left,
    its documents stand in the order of a hash of their ids (md5 of seed and id), and those whose words end within the rest
    are taken once more; of the one that crosses it, so many words that the source gives its target, rounded to a whole word, exactly.

    A null text has no words, a null source is a source, the last one; a null id is hashed as an empty one. Rows that
    share an id are told apart by their sizes; those that are equal in all of that are interchangeable, so reruns
    agree. Empty texts take nothing. An empty table gives no rows. Other columns are ignored; so are clashing ones, for only the three named are read.

    At scale: texts are read once, for their sizes, and never shuffled. Sizes are dealt in ranges of (source, hash, id, place), so neither a
    source nor a repeated id gathers in a task.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    counted = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), (words(F.col(text_col)) if size is None else F.coalesce(size.cast("bigint"), F.lit(0))).alias("size"))
    counted = scratch.table("sizes", counted.withColumn("place", F.monotonically_increasing_id()))
    sources = scratch.table("sources", counted.groupBy("source").agg(F.sum("size").alias("source_size")))
    aimed = scratch.table("targets", targets(sources, scratch, weights=weights, share=share, most=most).withColumnRenamed("source", "of"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = counted.join(aimed, F.col("source").eqNullSafe(F.col("of"))).select("grp", "size", key.alias("key"), "id", "place", "source_size", "target")
    summed = prefix_sums(rows, [F.col(c) for c in ("grp", "key", "id", "size", "place")], scratch, "sums")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return summed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def passes(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: docs with `epoch` (from 0) and `words_taken`, one row for each pass over a document, its text cut behind that many words.

    Needs unique ids (rows without one have no passes). The texts meet their rows of `mixed` by id.
    """
    plan = mixed.where("taken > 0").select(F.col(id_col), "size", "taken", F.explode(F.sequence(F.lit(0), F.ceil((F.col("taken") - F.col("size")) / F.col("size")).cast("int"))).alias("epoch"))
    plan = plan.select(id_col, "size", "epoch", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")).alias("words_taken"))
    kept = docs.drop("size", "epoch", "words_taken").join(plan, id_col)
    # a cut is behind a whole word; only the one document of each source that crosses its budget is cut
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words_taken").cast("int")), "")
    return kept.withColumn(text_col, F.when(F.col("words_taken") < F.col("size"), first).otherwise(F.col(text_col))).drop("size")


def op11_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, source_size * 3 / CAST(weight AS DOUBLE) AS full_at, (sum(source_size) OVER ()) AS total, coalesce(sum(source_size * 3) OVER before, 0) AS stopped, (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM w WINDOW before AS (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(CAST(total - stopped AS DOUBLE) / left_weight, full_at) AS level FROM o WHERE full_at >= CAST(total - stopped AS DOUBLE) / left_weight),
t AS (SELECT source, source_size, CASE WHEN level * weight > source_size * 3 THEN CAST(source_size * 3 AS DOUBLE) ELSE level * weight END AS target FROM w, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('11:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END AS BIGINT) AS taken FROM p
"""
