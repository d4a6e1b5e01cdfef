"""Connected components of a links table, all in joins and minima: no list of neighbours is ever gathered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import Scratch

#: Links that a task joins up at one time.
LINKS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it is joined to) of links, one for each node but the least of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        # hook roots, not nodes: whole trees move
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not (new == (up := new[new])).all():
            new = up
        if (new == root).all():
            break
        root = new
    down = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[down], nodes[root[down]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1))
        node, root = forest(u, v)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= LINKS:
            yield out()
    if held:
        yield out()


def components(links: DataFrame, scratch: Scratch, tag: str = "cc", most: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b: bigint), root the smallest node reachable; root rows are included.

    Each task first joins up the links it holds, LINKS at a time, and passes on a forest.  Then large-star and small-star steps alternate: each
    node hooks its larger, then its smaller neighbours onto the smallest node it sees.  Both steps are a
    minimum per node (summed up before the shuffle, so a hub costs a row a task)
    and a join whose skew Spark can split.  Ends when a step changes nothing.
    """
    e = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.table(f"{tag}0", e.mapInArrow(B.tidy(_joined), "u bigint, v bigint"))
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = state(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for k in range(1, most + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = scratch.table(f"{tag}{k}", small)
        scratch.drop(f"{tag}{k - 1}")
        e, now = nxt, state(nxt)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no rest after {most} steps")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def extend(label: DataFrame, links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, root) of components `label` after more links: only what links their roots is joined up anew."""
    end = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    short = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
    short = scratch.table(f"{tag}short", short)
    if short.isEmpty():
        return label
    more = components(short, scratch, tag).select(F.col("node").alias("n"), F.col("root").alias("r"))
    old = label.join(more, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    new = more.join(label.select(F.col("node").alias("n")), "n", "left_anti").select(F.col("n").alias("node"), F.col("r").alias("root"))
    return scratch.table(f"{tag}label", old.unionByName(new))
