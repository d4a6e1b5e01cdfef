"""Rank fusion, routes, widening and the hybrid search that puts them together for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import lexical, vectors
from .index import written

if TYPE_CHECKING:
    from .keyword_index import KeywordIndex
    from .vector_index import VectorIndex

#: Fixed values.
RRF_K, MIN_KEEP, LATE_POOL, FINAL_TOP_K, DEEP_TOP_K, RERANK_MIN_MB = 60, 3, 40, 12, 20, 1400
FAMILY_KEYWORDS = {
    "459": ("life saving", "life-saving", "lifesaving", "life saving rules"),
    "456": ("lopc", "process safety event", "tier 1", "tier 2", "tier 1 and 2"),
    "S-737": ("deluge", "deluge skid"),
    "S-717": ("noise", "noise emitting", "sound pressure"),
    "S-719": ("water mist", "watermist"),
}
ROLE_KEYWORDS = {
    "TRS": ("design", "technical", "shall be provided", "installation", "fabrication"),
    "QRS": ("quality", "inspection", "test certificate", "conformity", "qrs"),
}
CODE = r"(?i)s[-\s]?(\d{3})|\b(459|456)\b"


def _keywords(question: Column, table: dict[str, tuple[str, ...]]) -> Column:
    low = F.lower(X.text(question))
    tests = [(name, reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])) for name, words in table.items()]
    return reduce(lambda out, t: F.when(t[1], t[0]).otherwise(out), reversed(tests), F.lit(None).cast("string"))


def infer_family(question: Column, strict: bool = False) -> Column:
    """Family that a question names by code (the first) or by keyword (in the table's order), else null.

    strict keeps the bare report numbers, which no stored family equals; otherwise they are written as stored ('IOGP 459').
    """
    q = X.text(question)
    spec, report = F.regexp_extract(q, CODE, 1), F.regexp_extract(q, CODE, 2)
    found = F.when(spec != "", F.concat(F.lit("S-"), spec)).when(report != "", report).otherwise(_keywords(question, FAMILY_KEYWORDS))
    return found if strict else F.when(found.isin("459", "456"), F.concat(F.lit("IOGP "), found)).otherwise(found)


def infer_role(question: Column) -> Column:
    return _keywords(question, ROLE_KEYWORDS)


def rrf(rankings: DataFrame, key: str = "chunk_id", k: int = RRF_K, digits: int = 12) -> DataFrame:
    """Rankings (query_id, source_ord, key, rank) fused: (query_id, key, score, rank). Equal scores keep the order in which keys are first met, source by source."""
    met = F.min(F.struct(F.col("source_ord").cast("bigint").alias("ord"), F.col("rank").cast("bigint").alias("rank")))
    fused = rankings.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), met.alias("met"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "met")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", key, "score", "rank")


def union_rankings(*rankings: DataFrame, key: str = "chunk_id") -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select("query_id", F.lit(i).alias("source_ord"), key, "rank") for i, r in enumerate(rankings)])


def routes(queries: DataFrame, chunks: DataFrame, least: int = MIN_KEEP) -> DataFrame:
    """(query_id, family, role, by_role) of the queries whose route narrows: counted by family and role, without a pair of query and chunk.

    queries: query_id, family, role.  A route that leaves fewer than `least` chunks is none; by_role says whether `least` survive the role too.
    """
    routed = queries.where("family is not null or role is not null").select("query_id", "family", "role")
    groups = chunks.groupBy("doc_family", "doc_role").agg(F.count("*").alias("c")).withColumns({"family": F.col("doc_family"), "role": F.col("doc_role")})
    n = lambda keys, name: groups.groupBy(*keys).agg(F.sum("c").alias(name)) if keys else groups.agg(F.sum("c").alias(name))
    known = routed.join(n(["family"], "nf"), "family", "left").join(n(["role"], "nr"), "role", "left").join(n(["family", "role"], "nb"), ["family", "role"], "left").crossJoin(F.broadcast(n([], "every")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    any_family = F.col("family").isNull()
    fits, same = F.when(any_family, zero("every")).otherwise(zero("nf")), F.when(any_family, zero("nr")).otherwise(zero("nb"))
    known = known.select("query_id", "family", "role", fits.alias("n"), F.when(F.col("role").isNotNull(), same).otherwise(0).alias("m"))
    return known.where(F.greatest("n", "m") >= least).select("query_id", "family", "role", (F.col("m") >= least).alias("by_role"))


def _admits(role_too: bool = True) -> Column:
    """Does the route of a row (family, role, by_role) admit its chunk (doc_family, doc_role)?"""
    family = F.col("family").isNull() | F.coalesce(F.col("family") == F.col("doc_family"), F.lit(False))
    return family & (~F.col("by_role") | F.coalesce(F.col("role") == F.col("doc_role"), F.lit(False))) if role_too else family


def allowed_chunks(queries: DataFrame, chunks: DataFrame, key: str = "chunk_id", least: int = MIN_KEEP) -> DataFrame:
    """(query_id, key) of the chunks each query's route admits; no row for a query without a route or whose route leaves fewer than `least`.

    queries: query_id, family, role.  The role narrows only if `least` survive it.
    """
    r, c = routes(queries, chunks, least), chunks.select(key, "doc_family", "doc_role")
    by_family = r.where("family is not null").join(c.withColumn("f", F.col("doc_family")), F.col("family") == F.col("f")).drop("f")
    by_role = r.where("family is null and by_role").join(c.withColumn("f", F.col("doc_role")), F.col("role") == F.col("f")).drop("f")
    every = r.where("family is null and not by_role").crossJoin(c)
    return by_family.unionByName(by_role).unionByName(every).where(_admits()).select("query_id", key)


def restrict(scored: DataFrame, chunks: DataFrame, rules: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Of (query_id, key, ...) those that the routes of `routes` admit; queries without a route keep all."""
    marked = scored.join(chunks.select(key, "doc_family", "doc_role"), key).join(rules, "query_id", "left")
    return marked.where(F.col("by_role").isNull() | _admits()).select(*scored.columns)


def apply_route(cands: DataFrame, queries: DataFrame, key: str = "chunk_id", least: int = MIN_KEEP) -> DataFrame:
    """Candidates (query_id, key, ..., doc_family, doc_role) narrowed to their query's route; unchanged where too few would be left."""
    routed = cands.join(queries.select("query_id", "family", "role"), "query_id", "left")
    fam = F.col("family").isNull() | (F.col("family") == F.col("doc_family"))
    both = F.coalesce(fam, F.lit(False)) & F.coalesce(F.col("role") == F.col("doc_role"), F.lit(False))
    w = Window.partitionBy("query_id")
    routed = routed.withColumn("in_f", F.coalesce(fam, F.lit(False))).withColumn("in_b", both).withColumn("nf", F.count_if("in_f").over(w)).withColumn("nb", F.count_if("in_b").over(w))
    by_role = F.col("role").isNotNull() & (F.col("nb") >= least)
    keep = F.when(by_role, F.col("in_b")).when(F.col("nf") >= least, F.col("in_f")).otherwise(F.lit(True))
    return routed.where(keep).drop("family", "role", "in_f", "in_b", "nf", "nb")


def widen(narrow: DataFrame, broad: DataFrame, least: int = MIN_KEEP) -> DataFrame:
    """The narrow ranking of each query, or the broad one where the narrow has fewer than `least` rows."""
    enough = narrow.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
    return narrow.join(enough, "query_id", "left_semi").unionByName(broad.join(enough, "query_id", "left_anti"))


def rerank_head(fused: DataFrame, scores: DataFrame, pool: int = LATE_POOL, limit: int = DEEP_TOP_K, key: str = "chunk_id", digits: int = 9) -> DataFrame:
    """The first `pool` of each query by new scores (query_id, key, score; ties keep their order), the rest behind them as they were."""
    marked = fused.select("query_id", key, "rank").join(scores.select("query_id", key, F.col("score").alias("s")), ["query_id", key], "left")
    head = F.col("rank") <= pool
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.round("s", digits)), "rank")
    return marked.withColumn("new", F.row_number().over(order)).where(F.col("new") <= limit).select("query_id", key, F.col("new").alias("rank"))


def rerank_strategy(mode: str = "auto", limit_mb: int | None = None, in_container: bool = False, least_mb: int = RERANK_MIN_MB) -> str:
    """'cross-encoder' or 'late-interaction'. on and off pin it; otherwise memory decides, an undeclared limit in a container counts as tight."""
    if mode in ("on", "off"):
        return "cross-encoder" if mode == "on" else "late-interaction"
    if limit_mb is None:
        return "late-interaction" if in_container else "cross-encoder"
    return "late-interaction" if limit_mb < least_mb else "cross-encoder"


def inferred_routes(queries: DataFrame) -> DataFrame:
    """(query_id, family, role) that the questions name."""
    return queries.select("query_id", infer_family(F.col("question")).alias("family"), infer_role(F.col("question")).alias("role"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, vecs: DataFrame, query_vecs: DataFrame, k: int = lexical.CANDIDATES, key: str = "chunk_id", route: bool = True, routed: DataFrame | None = None, index: KeywordIndex | None = None, vector_index: VectorIndex | None = None, least: int = MIN_KEEP) -> DataFrame:
    """Fused ranking (query_id, key, score, rank) of three lists: vectors, body and title keywords, each narrowed by the question's route.

    chunks: key, page_content, clause_id, heading, doc_family, doc_role; queries: query_id, question;
    vecs: key, vec; query_vecs: query_id, vec.  `routed` (query_id, family, role) replaces what the questions name; `index` (with the fields
    page_content and title_text) spares reading the chunks' texts, `vector_index` (grouped by family) reading all vectors; where they aren't there yet, to build them
    costs more than one batch of questions does without.

    The vector list is the first k of the family; what the route forbids goes from these k, and fewer than `least` are replaced
    by the first k of all.  The keyword lists are the first k of what the route admits.
    """

    def keyword_list(field: str, rules: DataFrame | None) -> DataFrame:
        if index is not None:
            return index.top_k(queries, k, field, rules=rules)
        return lexical.bm25_top_k(lexical.title_field(chunks), queries, k, field=field, key=key, rules=rules)

    if vector_index is None:
        query_vecs = written(query_vecs, "asked")  # a vector a question, sent to every task
    broad = vectors.vector_top_k(vecs, query_vecs, k, key) if vector_index is None else vector_index.top_k(query_vecs, k)
    if not route:
        return rrf(union_rankings(broad, keyword_list("page_content", None), keyword_list("title_text", None), key=key), key)
    named = inferred_routes(queries) if routed is None else routed.select("query_id", "family", "role")
    rules = routes(named, chunks, least)
    # a family filters the vector scan whether or not its route is wide enough to narrow
    families = named.where("family is not null").select("query_id", "family")
    of_family = query_vecs.join(families.withColumnRenamed("family", "grp"), "query_id")
    if vector_index is not None:
        near = vector_index.top_k(of_family, k)
    else:
        near = vectors.vector_top_k(vecs.join(chunks.select(key, F.col("doc_family").alias("grp")), key), of_family, k, key)
    broad, near = written(broad, "broad"), written(near, "near")  # each is read twice: few rows a question
    plain = broad.join(families, "query_id", "left_anti")
    kept = restrict(near.unionByName(plain), chunks, rules, key).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    near = widen(written(kept, "kept"), broad, least)
    return rrf(union_rankings(near, keyword_list("page_content", rules), keyword_list("title_text", rules), key=key), key)


def search(chunks: DataFrame, queries: DataFrame, vecs: DataFrame, query_vecs: DataFrame, rerank: Callable[[DataFrame], DataFrame], limit: int | None = None, strategy: str = "cross-encoder", key: str = "chunk_id", **how) -> DataFrame:
    """(query_id, key, rank): route, three lists, fusion, rerank, cut.

    `rerank` gives (query_id, key, score) for (query_id, key, rank) and stands for a model.  A cross-encoder scores all fused candidates and the first
    FINAL_TOP_K stay; vectors without a chunk are no candidates; late interaction scores the first LATE_POOL, the others stay behind them, DEEP_TOP_K in all.  A `limit` of none or zero is that default.
    """
    fused = hybrid_search(chunks, queries, vecs, query_vecs, key=key, **how).join(chunks.select(key), key, "left_semi")
    # ranked once; the reranker reads it as well
    fused = written(fused.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank")), "fused")
    if strategy == "cross-encoder":
        return rerank_head(fused, rerank(fused), pool=3 * lexical.CANDIDATES, limit=limit or FINAL_TOP_K, key=key)
    return rerank_head(fused, rerank(fused.where(F.col("rank") <= LATE_POOL)), pool=LATE_POOL, limit=limit or DEEP_TOP_K, key=key)
