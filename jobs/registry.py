"""The jobs as queries: each runs twice into one new folder, and what stands there after the second run is the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.index import scratch_path
from evidentia.plans.base import STRIP, bm25, ranked
from evidentia.plans.evidence_queries import QUOTED
from evidentia.plans.structure_queries import NOISE, PACK

from . import ingest_chunks, search_quality


def job1_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental job: the second run finds its checkpoint and nothing new."""
    out = scratch_path(spark, "job1")
    for _ in range(2):
        made = ingest_chunks.run(spark, f"{sf_dir}/documents.parquet", out)
    return made.select("doc_id", "lang", "seq", F.col("piece").cast("bigint").alias("piece"), F.col("tokens").cast("bigint").alias("tokens"), F.md5(F.col("page_content").cast("binary")).alias("content_md5"))


def job2_search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run opens the index that the first has built."""
    out = scratch_path(spark, "job2")
    for _ in range(2):
        made = search_quality.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return made.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "supported", F.col("first_supported").cast("bigint").alias("first_supported"), "lang")


# The packing of the catalogue, over documents of one page without blank lines and page numbers, to 85 % of 512 words.
_PAGES = rf"""spec AS (SELECT CAST(doc_id AS VARCHAR) AS source_file, 1 AS page, coalesce((SELECT string_agg(ls[u.i], chr(10) ORDER BY u.i) FROM unnest(range(1, len(ls) + 1)) AS u(i) WHERE {STRIP.format('ls[u.i]')} <> '' AND NOT regexp_matches(ls[u.i], '{NOISE}')), '') AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""


def _packed() -> str:
    begin, end = PACK.index("spec AS ("), PACK.index(", lines AS (")
    return PACK[:begin] + _PAGES + PACK[end:].replace("greatest(20, 60 - (", "greatest(20, 435 - (")


JOB1_SQL = f"WITH {_packed()} SELECT doc_id, lang, seq, CAST(piece AS BIGINT) AS piece, tokens, md5(page_content) AS content_md5 FROM packed JOIN documents ON CAST(doc_id AS VARCHAR) = source_file"
JOB2_SQL = f"""WITH chunks AS (SELECT doc_id AS chunk_id, text AS page_content, lang FROM documents), questions AS (SELECT item_id AS query_id, text AS question FROM benchmark), {bm25()}, {ranked('bm', 'r', 10)},
p AS (SELECT r.*, c.lang, c.page_content AS e, q.question AS q, string_split(lower(trim(regexp_replace(coalesce(question, ''), '\\s+', ' ', 'g'))), ' ') AS qw FROM r JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id)),
s AS (SELECT query_id, rank, chunk_id AS doc_id, round(score, 6) AS score, {QUOTED.format(q='q', e='e')} AS supported, lang FROM p)
SELECT *, min(CASE WHEN supported THEN rank END) OVER (PARTITION BY query_id) AS first_supported FROM s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_ingest_chunks": job1_ingest_chunks, "job2_search_quality": job2_search_quality}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_chunks": JOB1_SQL, "job2_search_quality": JOB2_SQL}
