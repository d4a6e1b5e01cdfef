"""Tables written between the steps of an operator, in the folder that driver and executors share.

A written table cuts lineage: a lost executor costs the tasks that ran on it, not
the steps before.  The folder is the one the session names in
spark.checkpoint.dir; only a local session (tests) without that setting gets one made here.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_live: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    where = conf or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Named tables of one run of an operator. They go when they are dropped, or with the driver."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        self._tables: list[str] = []
        _live.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """df, written once and read back."""
        df.write.option("compression", "zstd").mode("errorifexists").parquet(self.path(name))
        return self.read(name, df)

    def bucketed(self, name: str, df: DataFrame, key: str, n: int) -> DataFrame:
        """df, dealt into n buckets by its key, written once and read back: joins on the key move only their other side."""
        table = f"{self.root.rpartition('/')[2]}_{name}".replace("-", "_")
        df.repartition(n, key).write.bucketBy(n, key).option("path", self.path(name)).option("compression", "none").format("parquet").saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of steps that are done: it does so when their plans are collected as garbage, else at some later time."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes a table, or all of them. Call it only when nothing lazy reads the table any more."""
        for table in [] if name else self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scope:
    """Tables that operators make inside `with Scope():` go at its end: for callers that write each result down before they leave."""

    def __enter__(self) -> Scope:
        self._before = len(_live)
        return self

    def __exit__(self, *failed: object) -> None:
        for s in _live[self._before :]:
            s.drop()
        del _live[self._before :]


@atexit.register
def _clean() -> None:
    for s in _live:
        try:
            s.drop()
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return
