"""How rows lie: enough partitions for all cores, and tables told apart by their files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores if the scan gives fewer partitions than these (a file of one row group is one task); as they are otherwise, and behind any shuffle."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # its partitions are known when it has run
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def files_signature(spark: SparkSession, *paths: str) -> str:
    """16 hex digits over the names, sizes and times of change of the files under these paths. Spark lists them; none is opened, and what is gathered is one row."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length")
    row = every.agg(F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.count("*"), F.sum("length")).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()[:16]
