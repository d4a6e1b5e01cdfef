"""Commands: `python -m evidentia.cli evaluate --docs FOLDER --golden FILE [--encoder MODULE:FACTORY [--scorer MODULE:FACTORY]] [--json FILE]`.

Without an encoder the keyword ranking is judged; with one the whole search: route, three lists, fusion and, with a scorer, rerank.
"""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, fusion, lexical, models, packing
from .operators.index import written
from .sources import files


def factory(name: str):
    """What MODULE:FACTORY names: a function without arguments that makes the model, once in each worker process."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _searched(chunks: DataFrame, asked: DataFrame, k: int, encoder: str, scorer: str | None) -> DataFrame:
    """(query_id, chunk_id, rank) of the whole search with the caller's models; without a scorer the fused order stays."""
    embed = models.embedder(factory(encoder), name=encoder)
    vecs = written(models.embed_distinct(chunks.select("chunk_id", "page_content"), "page_content", embed, model=encoder, role="passage").select("chunk_id", "vec"), "vectors")
    query_vecs = written(models.embed_distinct(asked, "question", embed, model=encoder, role="query").select("query_id", "vec"), "query-vectors")
    if scorer is None:
        fused = fusion.hybrid_search(chunks, asked, vecs, query_vecs)
        return fused.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")
    score = models.pair_scorer(factory(scorer), name=scorer)
    pairs = lambda fused: fused.join(asked, "query_id").join(chunks.select("chunk_id", "page_content"), "chunk_id").select("query_id", "chunk_id", score(F.col("question"), F.col("page_content")).alias("score"))
    return fusion.search(chunks, asked, vecs, query_vecs, pairs, limit=k)


def evaluated(spark: SparkSession, docs: str, golden: str, k: int = 12, encoder: str | None = None, scorer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per question, one row of rates) of retrieval over a folder of documents."""
    chunks = written(packing.build_chunks(files.load_pages(spark, docs)), "chunks")
    gold = files.golden(spark, golden)
    asked = gold.select(F.col("id").alias("query_id"), "question")
    ranked = lexical.bm25_top_k(chunks, asked, k) if encoder is None else _searched(chunks, asked, k, encoder, scorer)
    got = ranked.join(chunks.select("chunk_id", "source_file", "page"), "chunk_id").select(F.col("query_id").alias("id"), "rank", F.col("source_file").alias("file"), "page")
    judged = evaluate.judge(got, gold)
    seen = got.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file", "page"))), lambda r: F.struct(r["file"].alias("file"), r["page"].alias("page"))).alias("retrieved"))
    rows = gold.join(judged, "id").join(seen, "id", "left")
    rate = lambda c: F.coalesce(F.lit(1.0) / F.col(c), F.lit(0.0))
    rows = rows.select("id", "question", "accepted", F.col("doc_rank").isNotNull().alias("doc_hit"), F.col("page_rank").isNotNull().alias("page_hit"), rate("doc_rank").alias("doc_rr"), rate("page_rank").alias("page_rr"), "retrieved")
    return rows, evaluate.report(judged, (6, k))


def show(rows: list[dict], rates: dict) -> str:
    """The report as text: rates, then a line per question, with what was expected and found where the page was missed."""
    k = max(int(c.rsplit("_", 1)[1]) for c in rates if "_hit_" in c)
    lines = [f"questions              {rates['questions']}"]
    for at in (6, k):
        lines += [f"{kind:4} hit-rate@{at:<2}       {rates[f'{kind}_hit_{at}']:.0%}" for kind in ("doc", "page")]
    lines += [f"{kind:4} MRR               {rates[f'{kind}_mrr']:.3f}" for kind in ("doc", "page")]
    for r in rows:
        lines.append(f"  {'OK  ' if r['page_hit'] else 'doc ' if r['doc_hit'] else 'MISS'} {r['id']:6} {r['question'][:56]}")
        if not r["page_hit"]:
            lines.append(f"         expected {r['accepted']}, got {(r['retrieved'] or [])[:3]}")
    return "\n".join(lines)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evidentia")
    command = parser.add_subparsers(dest="command", required=True).add_parser("evaluate", help="retrieval quality against golden questions")
    command.add_argument("--docs", required=True, help="folder of .md, .txt and .pdf files")
    command.add_argument("--golden", required=True, help="YAML file of questions")
    command.add_argument("--top", type=int, default=12, help="excerpts per question")
    command.add_argument("--encoder", help="module:factory of a text encoder, for the whole search")
    command.add_argument("--scorer", help="module:factory of a cross-encoder")
    command.add_argument("--json", help="file for the rows per question")
    given = parser.parse_args(args)
    if spark is None:
        from .session import local_session

        spark = local_session(4, memory="2g")
    rows, rates = evaluated(spark, given.docs, given.golden, given.top, given.encoder, given.scorer)
    made = [r.asDict(recursive=True) for r in rows.orderBy("id").collect()]  # a golden set is a short list by nature
    print(show(made, rates.first().asDict()))
    if given.json:
        Path(given.json).write_text(json.dumps(made, indent=2, ensure_ascii=False), encoding="utf-8")


if __name__ == "__main__":
    main()
