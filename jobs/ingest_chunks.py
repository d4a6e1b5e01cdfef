"""Keeps the chunks of a growing folder of documents up to date; each run takes only the files that came since the last one.

    python -m jobs.ingest_chunks --documents FOLDER --out FOLDER [--config jobs/ingest_chunks.json]

Files of (doc_id, text, lang) arrive as Parquet. A file stream with a checkpoint under OUT takes the new ones, batch by batch
(availableNow), and leaves out documents whose text is the one already taken. The rest are cut into clauses and packed into chunks.
OUT/chunks is partitioned by lang and ingest (the batch's number), OUT/taken (doc_id, sha256) by ingest. A
batch that is run again after a crash overwrites its own partitions; a document that comes again with another text is
replaced: `current` reads the chunks of each document's latest ingest.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import packing
from evidentia.streaming.admission import file_stream

log = logging.getLogger("jobs.ingest_chunks")
CONFIG = Path(__file__).with_suffix(".json")
TAKEN = "doc_id bigint, sha256 string, ingest bigint"
CHUNKS = "doc_id bigint, seq bigint, piece int, clause_id string, title string, tokens int, page_content string, lang string, ingest bigint"


def read_config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def taken(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, sha256, ingest) of each document at its latest ingest."""
    rows = spark.read.schema(TAKEN).parquet(f"{out}/taken")
    return rows.groupBy("doc_id").agg(F.max_by("sha256", "ingest").alias("sha256"), F.max("ingest").alias("ingest"))


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks as they stand: those of complete ingests, without what a later ingest of the same document has replaced.

    An ingest that crashed before OUT/taken named it isn't there yet. Few numbers of ingests and the replaced ids meet the chunks; nothing else does.
    """
    rows = spark.read.schema(TAKEN).parquet(f"{out}/taken").select("doc_id", "ingest")
    replaced = rows.join(taken(spark, out).select("doc_id", F.col("ingest").alias("latest")), "doc_id").where("ingest < latest").select("doc_id", "ingest")
    # a shuffle by ingest would send a whole ingest to one task
    complete = spark.read.schema(CHUNKS).parquet(f"{out}/chunks").join(F.broadcast(rows.select("ingest").distinct()), "ingest", "left_semi")
    return complete.join(replaced, ["doc_id", "ingest"], "left_anti")


def changed(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, sha256, lang, text) of the documents of a batch that are new or have another text than the known one.

    Of rows that share an id the one of the newest file counts, then the larger text hash. Rows without an id can't be replaced later and are left out.
    """
    rows = batch.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), "lang", "text", "at")
    newest = Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("sha256"), "lang")
    one = rows.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "at")
    return one.join(known.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")


def chunked(documents: DataFrame, window: int, min_tokens: int) -> DataFrame:
    """Documents, one page each, as chunks of the library's pipeline."""
    pages = documents.select(F.col("doc_id").cast("string").alias("source_file"), F.lit(1).alias("page"), "text")
    made = packing.build_chunks(pages, window, min_tokens)
    rows = made.select(F.col("source_file").cast("bigint").alias("doc_id"), "seq", "piece", "clause_id", "title", "tokens", "page_content")
    return rows.join(documents.select("doc_id", "lang"), "doc_id")


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> DataFrame:
    """Takes what is new under `documents` into `out` and gives back all chunks as they stand."""
    given = read_config() | (config or {})
    spark.createDataFrame([], TAKEN).write.mode("ignore").partitionBy("ingest").parquet(f"{out}/taken")
    spark.createDataFrame([], CHUNKS).write.mode("ignore").partitionBy("lang", "ingest").parquet(f"{out}/chunks")

    def take(batch: DataFrame, number: int) -> None:
        # a crashed run of this same batch may have left rows: only earlier batches are known
        earlier = spark.read.schema(TAKEN).parquet(f"{out}/taken").where(F.col("ingest") < number)
        known = earlier.groupBy("doc_id").agg(F.max_by("sha256", "ingest").alias("sha256"))
        new = changed(batch, known)
        write = lambda df, name, *by: df.withColumn("ingest", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
        write(chunked(new, given["window"], given["min_tokens"]), "chunks", "lang", "ingest")
        write(new.select("doc_id", "sha256"), "taken", "ingest")  # last: what it names is complete
        read = batch.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
        log.info("batch %d: read %d rows (%d without an id), took %d documents", number, read[0], read[1], spark.read.schema(TAKEN).parquet(f"{out}/taken").where(F.col("ingest") == number).count())

    stream = file_stream(spark, documents, given["files_per_batch"]).select("doc_id", "text", "lang", F.col("_metadata.file_modification_time").alias("at"))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    made = current(spark, out)
    log.info("read %s, %d batches in this run; %s/chunks now holds %d chunks", documents, len([p for p in query.recentProgress if p["numInputRows"]]), out, made.count())
    return made


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ingest_chunks")
    parser.add_argument("--documents", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_chunks").getOrCreate()
    try:
        run(spark, given.documents, given.out, read_config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
