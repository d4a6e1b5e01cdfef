"""How well the keyword search finds the passages that questions quote, over all documents.

    python -m jobs.search_quality --documents PATH --questions PATH --out FOLDER [--config jobs/search_quality.json]

Reads documents (doc_id, text, lang) and questions (item_id, text). The keyword index under OUT/index is built once for a state of the documents'
files and opened by later runs. Each question's first excerpts are checked for its words, `window` in a row, as citations are. OUT/excerpts
(query_id, rank, doc_id, score, supported, first_supported) is partitioned by the documents' lang; rates are logged. A run overwrites OUT/excerpts with what the tables
give now, so running again gives the same.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import evaluate, keyword_index
from evidentia.operators.layout import files_signature

log = logging.getLogger("jobs.search_quality")
CONFIG = Path(__file__).with_suffix(".json")
EXCERPTS = "query_id bigint, rank int, doc_id bigint, score double, supported boolean, first_supported int, lang string"


def read_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def judged(ranked: DataFrame, questions: DataFrame, documents: DataFrame, window: int) -> DataFrame:
    """Ranked documents with lang, whether they hold the question's words, and the first rank of the question that does.

    The few ranked pairs go to the texts. Documents that share an id count as one: supported if any is.
    """
    texts = ranked.join(documents.select("doc_id", "text", "lang"), "doc_id").join(questions, "query_id")
    each = texts.select("query_id", "rank", "doc_id", "score", "lang", X.quote_supported(F.col("question"), F.col("text"), window).alias("supported"))
    one = each.groupBy("query_id", "rank", "doc_id", "score").agg(F.max("supported").alias("supported"), F.min("lang").alias("lang"))
    first = F.min(F.when(F.col("supported"), F.col("rank"))).over(Window.partitionBy("query_id"))
    return one.withColumn("first_supported", first)


def rates(excerpts: DataFrame, questions: DataFrame, top: int) -> DataFrame:
    """One row: questions, hit rates at 1 and `top`, and mean reciprocal rank of the first excerpt that holds the words."""
    first = excerpts.groupBy("query_id").agg(F.min("first_supported").alias("doc_rank"))
    rows = questions.select("query_id").join(first, "query_id", "left").select("doc_rank", F.col("doc_rank").alias("page_rank"))
    return evaluate.report(rows, (1, top)).select("questions", F.col("doc_hit_1").alias("hit_1"), F.col(f"doc_hit_{top}").alias(f"hit_{top}"), F.col("doc_mrr").alias("mrr"))


def run(spark: SparkSession, documents: str, questions: str, out: str, config: dict | None = None) -> DataFrame:
    """Judges the search over `documents` into `out` and gives back all excerpts."""
    given = read_config() | (config or {})
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang")
    asked = spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    stored = keyword_index.ensure(docs.where("doc_id is not null"), ["text"], f"{out}/index", files_signature(spark, documents), key="doc_id")
    ranked = stored.top_k(asked, given["top"], field="text")
    judged(ranked, asked, docs, given["window"]).select("query_id", "rank", "doc_id", "score", "supported", "first_supported", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/excerpts")
    made = spark.read.schema(EXCERPTS).parquet(f"{out}/excerpts")
    log.info("read %s (%d documents) and %s (%d questions); wrote %d rows to %s/excerpts", documents, stored.docs.count(), questions, asked.count(), made.count(), out)
    log.info("rates: %s", rates(made, asked, given["top"]).first().asDict())
    return made


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="search_quality")
    parser.add_argument("--documents", required=True)
    parser.add_argument("--questions", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("search_quality").getOrCreate()
    try:
        run(spark, given.documents, given.questions, given.out, read_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
