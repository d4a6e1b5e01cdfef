"""Questions to verified answers: capability questions apart, retrieve, generate, verify, and once more where nothing held."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_capability_question
from . import evidence, models
from .index import written

#: Excerpts of the first attempt, of a second after rejected claims, of a second after none.
FIRST, DEEPER, SHORTER = 12, 24, 6


def _attempt(queries: DataFrame, ranking: DataFrame, chunks: DataFrame, depth: DataFrame, names: list[str], load: Callable) -> tuple[DataFrame, DataFrame]:
    excerpts = ranking.join(depth, "query_id").where(F.col("rank") <= F.col("depth")).join(chunks, "chunk_id")
    context = evidence.format_excerpts(excerpts).join(queries.select("query_id", "question"), "query_id")
    drafts = written(models.generate(context, names, load), "drafts")
    flags = drafts.select("query_id", F.coalesce(F.from_json("draft", evidence.DRAFT)["not_found"], F.lit(False)).alias("not_found"))
    verified = evidence.verify(evidence.parse_drafts(drafts), excerpts)
    return evidence.answers(queries.join(depth.select("query_id"), "query_id", "left_semi"), verified, excerpts, flags), verified


def ask(queries: DataFrame, ranking: DataFrame, chunks: DataFrame, names: list[str], load: Callable, capability: str = "") -> DataFrame:
    """One row per question: query_id, answer, n_claims, n_rejected, not_found, sources, clauses, retried.

    ranking: query_id, chunk_id, rank.  A question whose first answer holds no claim is asked once more, with more
    excerpts if claims were rejected, with fewer otherwise; the first answer stands if the second has none either.
    The models are asked when this is called; what they said is kept as tables in the shared folder.
    """
    own = queries.withColumn("self", is_capability_question(F.col("question")))
    about = own.where("self").select("query_id", F.lit(capability).alias("answer"), F.lit(0).alias("n_claims"), F.lit(0).cast("bigint").alias("n_rejected"), F.lit(False).alias("not_found"), F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("clauses"), F.lit(False).alias("retried"))
    rest = own.where(~F.col("self")).drop("self")
    first, _ = _attempt(rest, ranking, chunks, rest.select("query_id", F.lit(FIRST).alias("depth")), names, load)
    first = written(first, "answers")
    again = first.where("not_found").select("query_id", F.when(F.col("n_rejected") > 0, DEEPER).otherwise(SHORTER).alias("depth"))
    second, _ = _attempt(rest, ranking, chunks, again, names, load)
    better = second.where(~F.col("not_found")).withColumn("retried", F.lit(True))
    stays = first.join(better.select("query_id"), "query_id", "left_anti").withColumn("retried", F.lit(False))
    return stays.unionByName(better).unionByName(about)
