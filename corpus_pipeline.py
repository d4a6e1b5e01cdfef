"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that
is written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, minhash, packing, substring
from evidentia.llm import toxicity as tox
from evidentia.llm._scratch import Scope, Scratch

#: Words of a repeated passage that the substring stage removes.
PASSAGE = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Fitted on the labelled ones of docs that are not held out; rows without text score low and stay, rows with a null id or a repeated one are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~tox.held_out(F.col("doc_id")))
    scored = tox.score(docs, tox.train(docs, labels))
    return scored.where("score < 0.5").drop("score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 5-word shingles at a similarity of 0.8 or more. Rows that share a kept id, and rows with a null id, stay."""
    return minhash.drop_near_duplicates(docs, k=5, threshold=(4, 5))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of PASSAGE-word runs that also start earlier; a document may end up empty. n_chars follows the text. Rows with a null id come first, rows of one id as they are stored."""
    cut = substring.dedup_windows(docs, window=PASSAGE)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even slightly edited. Rows are judged one by one: null and repeated ids change nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, also of rows with a null id or a repeated one."""
    return packing.pack(docs, tokenizer=packing.default_tokenizer(), capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]

#: No SQL: a fitted model, min-max signatures and a tokenizer. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with Scope():
            docs = scratch.table(name, stage(spark, docs, sf_dir))
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
