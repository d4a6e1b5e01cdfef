"""Claims against the excerpts they cite, and the answers made of those that hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed values.
NOT_RETRIEVED = "citation is not one of the retrieved excerpts"
NOT_QUOTED = "quote does not appear in the cited excerpt"
CLAIM = "struct<text:string,clause_id:string,source_file:string,page:int,quote:string>"
DRAFT = f"struct<claims:array<{CLAIM}>,not_found:boolean>"


def parse_drafts(raw: DataFrame, json_col: str = "draft") -> DataFrame:
    """(query_id, pos, text, clause_id, source_file, page, quote) of model answers in JSON; malformed ones have no claims."""
    return raw.select("query_id", F.posexplode(F.from_json(json_col, DRAFT)["claims"]).alias("pos", "c")).select("query_id", "pos", "c.*")


def verify(claims: DataFrame, excerpts: DataFrame, strict: bool = False) -> DataFrame:
    """Claims with accepted and reason.

    excerpts: query_id, rank, source_file, page, clause_id, page_content.  A claim's excerpt is
    the one with its file, page and clause; without one, the best-ranked on that page in which the clause number occurs.
    Of several with the same key strict checks the worst-ranked alone, otherwise any may hold the quote.
    """
    key = ["query_id", "source_file", "page"]
    e = excerpts.select(*key, X.text(F.col("clause_id")).alias("e_clause"), "rank", "page_content")
    pairs = claims.select("query_id", "pos", "source_file", "page", X.text(F.col("clause_id")).alias("clause"), "quote").join(e, key)
    pairs = pairs.withColumn("own", F.col("clause") == F.col("e_clause")).withColumn("within", X.clause_present(F.col("clause"), F.col("page_content")))
    pairs = pairs.where("own or within").withColumn("ok", X.quote_supported(F.col("quote"), F.col("page_content")))
    last = F.max_by("ok", F.when(F.col("own"), F.col("rank")))
    own = last if strict else F.bool_or(F.when(F.col("own"), F.col("ok")))
    found = pairs.groupBy("query_id", "pos").agg(F.bool_or("own").alias("has"), own.alias("own_ok"), F.min_by("ok", F.when(~F.col("own"), F.col("rank"))).alias("in_ok"), F.count("*").alias("n"))
    out = claims.join(found, ["query_id", "pos"], "left")
    accepted = F.when(F.col("has"), F.col("own_ok")).otherwise(F.col("in_ok"))
    reason = F.when(F.col("n").isNull(), NOT_RETRIEVED).when(~accepted, NOT_QUOTED)
    return out.withColumn("accepted", F.col("n").isNotNull() & F.coalesce(accepted, F.lit(False))).withColumn("reason", reason).drop("has", "own_ok", "in_ok", "n")


def answers(queries: DataFrame, verified: DataFrame, excerpts: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """One row per query: answer, n_claims, n_rejected, not_found, sources, clauses (sorted)."""
    claim = F.struct("pos", "text", "source_file", "page")
    done = verified.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("accepted"), claim))).alias("claims"), F.count_if(~F.col("accepted")).alias("n_rejected"))
    seen = excerpts.groupBy("query_id").agg(F.array_sort(F.collect_set("source_file")).alias("sources"), F.array_sort(F.collect_set("clause_id")).alias("clauses"))
    out = queries.select("query_id").join(done, "query_id", "left").join(seen, "query_id", "left")
    flag = F.lit(False)
    if drafts is not None:
        out = out.join(drafts.select("query_id", "not_found"), "query_id", "left")
        flag = F.coalesce("not_found", F.lit(False))
    n = F.coalesce(F.size("claims"), F.lit(0))
    return out.select("query_id", X.render_answer(F.col("claims")).alias("answer"), F.greatest(n, F.lit(0)).alias("n_claims"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), (flag | F.col("claims").isNull() | (F.size("claims") == 0)).alias("not_found"), "sources", "clauses")


def format_excerpts(excerpts: DataFrame, citable: bool = True, blank: str = "-", by_rank: bool = False) -> DataFrame:
    """(query_id, context): the numbered excerpts of each query in rank order, a blank line between.

    `citable` names the other clauses inside an excerpt, `blank` stands for an empty clause; numbers are the ranks if `by_rank`, else without gaps.
    """
    numbered = excerpts.withColumn("number", F.col("rank") if by_rank else F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    one = X.format_excerpt(F.col("number"), F.col("source_file"), F.col("clause_id"), F.col("page"), F.col("page_content"), citable, blank)
    return numbered.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", one.alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))


def groundedness(verified: DataFrame) -> DataFrame:
    """One row: claims, accepted, validity (null without claims), answered queries."""
    return verified.agg(F.count("*").alias("claims"), F.count_if("accepted").alias("accepted"), F.when(F.count("*") > 0, F.count_if("accepted") / F.count("*")).alias("validity"), F.count_distinct(F.when(F.col("accepted"), F.col("query_id"))).alias("answered"))
