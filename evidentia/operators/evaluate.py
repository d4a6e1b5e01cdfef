"""Hit rates and reciprocal ranks of retrieved pages against golden questions, all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED = "array<struct<file:string,pages:array<int>>>"


def accepted(file: Column, pages: Column, also: Column) -> Column:
    """The expected file and pages and the alternatives in one list; a file without pages accepts any."""
    return F.concat(F.array(F.struct(file.alias("file"), F.coalesce(pages, F.array().cast("array<int>")).alias("pages"))), F.coalesce(also, F.array().cast(ACCEPTED)))


def judge(retrieved: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per question: doc_rank, page_rank (first accepted, null if none). retrieved: id, rank, file, page; golden: id, accepted."""
    both = retrieved.join(golden.select("id", "accepted"), "id")
    doc = F.exists("accepted", lambda a: a["file"] == F.col("file"))
    page = F.exists("accepted", lambda a: (a["file"] == F.col("file")) & ((F.size(a["pages"]) == 0) | F.array_contains(a["pages"], F.col("page"))))
    first = both.groupBy("id").agg(F.min(F.when(doc, F.col("rank"))).alias("doc_rank"), F.min(F.when(page, F.col("rank"))).alias("page_rank"))
    return golden.select("id").join(first, "id", "left")


def report(judged: DataFrame, ks: tuple[int, ...] = (6, 12)) -> DataFrame:
    """One row: questions, doc_hit_k and page_hit_k for each k, doc_mrr, page_mrr."""
    hit = lambda c, k: F.avg(F.coalesce((F.col(c) <= k).cast("int"), F.lit(0))).alias(f"{c.split('_')[0]}_hit_{k}")
    mrr = lambda c: F.avg(F.coalesce(F.lit(1.0) / F.col(c), F.lit(0.0))).alias(f"{c.split('_')[0]}_mrr")
    return judged.agg(F.count("*").alias("questions"), *[hit(c, k) for k in ks for c in ("doc_rank", "page_rank")], mrr("doc_rank"), mrr("page_rank"))
