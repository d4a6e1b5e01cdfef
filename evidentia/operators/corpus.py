"""What the index holds: families, sources, names, conversation logs, configured models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


CLOSING = "Whatever those files don't say stays unanswered: a claim without a passage that carries it is left out."


def sources(chunks: DataFrame) -> DataFrame:
    return chunks.where("source_file <> ''").select("source_file").distinct()


def families(chunks: DataFrame) -> DataFrame:
    return chunks.where("doc_family <> ''").select("doc_family").distinct()


def holds_family(chunks: DataFrame, family: str = "IOGP 459") -> DataFrame:
    """One row: does the corpus hold this family, so that the full set of sample questions fits?"""
    return chunks.agg(F.coalesce(F.bool_or(F.col("doc_family") == family), F.lit(False)).alias("full_pack"))


def counts(pages: DataFrame) -> DataFrame:
    """One row: documents (files that have a page) and pages."""
    return pages.agg(F.count_distinct("source_file").alias("documents"), F.count("*").alias("pages"))


def capability_answer(chunks: DataFrame, names: dict[str, str], cards: list[str], questions: dict[str, list[str]]) -> DataFrame:
    """One row: what can be asked, made of the sources in the index and the configuration."""
    from ..functions.text import lookup

    listed = sources(chunks).agg(F.array_sort(F.collect_set("source_file")).alias("s"))
    shown = F.array_join(F.transform("s", lambda x: lookup(x, names)), ", ")
    tail = "\n".join(["", "Subjects:", *[f"- {c}" for c in cards], "", "For example:", *[f"- {k}: " + "; ".join(v) for k, v in questions.items()], "", CLOSING])
    return listed.select(F.concat(F.lit("These files can be searched: "), shown, F.lit(".\n" + tail)).alias("answer"))


def missing_models(wanted: list[str], available: DataFrame) -> DataFrame:
    """Configured models (spaces around them dropped, each once) that the provider doesn't list."""
    spark = available.sparkSession
    names = list(dict.fromkeys(m.strip() for m in wanted if m.strip()))
    listed = F.explode(F.array(*[F.lit(m) for m in names])) if names else F.explode(F.array().cast("array<string>"))
    return spark.range(1).select(listed.alias("model")).join(available.select("model"), "model", "left_anti")


def clear_conversation(turns: DataFrame, conv_id: int, confirmed: bool = False) -> DataFrame:
    """The turns without those of one conversation; unchanged unless the clearing is confirmed."""
    return turns.where(~F.col("conv_id").eqNullSafe(F.lit(conv_id))) if confirmed else turns


def conversation_log(turns: DataFrame) -> DataFrame:
    """One row per conversation: turns, roles and texts in order."""
    ordered = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("log"))
    return ordered.select("conv_id", "turns", F.col("log.role").alias("roles"), F.col("log.text").alias("texts"))
