"""The index on disk: built once, signed last, opened only if the signature fits.

Each state of the corpus has a folder of its own under the index's path, named after its signature. A new one is built beside those that readers hold
open, is there for new readers once it is signed, and takes the chunks of unchanged files over from the last one; old states are dropped when nobody reads them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 16


def signature(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, DIGITS)


def signature_of(spark: SparkSession, *parts: str) -> str:
    return spark.range(1).select(signature(*[F.lit(p) for p in parts])).first()[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once: it is made once, also when an executor is lost."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(path: str, signed: str) -> str:
    """The folder of one state of an index."""
    return f"{path}/{uuid.uuid5(uuid.NAMESPACE_OID, signed).hex[:16]}"


def drop_others(spark: SparkSession, path: str, signed: str) -> int:
    """Deletes all states but one, once nothing reads them any more; how many there were."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName() != state("", signed)[1:]]
    for p in old:
        fs.delete(p, True)
    return len(old)


def build(chunks: DataFrame, path: str, signed: str) -> None:
    """Writes a state of the index. The signature goes last: a crash leaves none, and the state is built anew. Partitioned by family, so a route prunes files."""
    spark, root = chunks.sparkSession, state(path, signed)
    unsign(spark, root)
    chunks.write.mode("overwrite").partitionBy("doc_family").parquet(f"{root}/chunks")
    sign(spark, root, signed)


def build_with_stats(pages: DataFrame, path: str, signed: str, window: int = 512, **how) -> dict[str, int | None]:
    """Pages to a signed index of chunks; what was built: chunks, least, median (the upper one of two), most, over (the window), documents, pages."""
    from . import corpus, packing

    chunks = packing.build_chunks(pages, window, **how)
    build(chunks, path, signed)
    stored = open_index(chunks.sparkSession, path, signed) if is_valid(chunks.sparkSession, path, signed) else chunks.limit(0)
    return packing.chunk_stats(stored, window).drop("about").crossJoin(corpus.counts(pages)).first().asDict()


def file_signatures(pages: DataFrame) -> DataFrame:
    """(source_file, signature): one hash over a file's pages in order; of each page only a hash is gathered."""
    page = F.struct("page", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    ordered = F.transform(F.array_sort(F.collect_list(page)), lambda p: F.concat(F.coalesce(p["page"].cast("string"), F.lit("")), F.lit(":"), p["hash"]))
    return pages.groupBy("source_file").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("signature"))


def build_changed(pages: DataFrame, path: str, signed: str, last: str | None = None, window: int = 512, **how) -> dict[str, int]:
    """Writes a state of the index of which only new and changed files are cut into chunks; those of files that state `last` holds unchanged are taken over.

    Gives {made, kept, gone}: files cut now, files taken over, files that are no more.  `last` must have been written by this function with the same window and counter.
    """
    from . import packing

    spark, root = pages.sparkSession, state(path, signed)
    known = last is not None and stored_signature(spark, state(path, last)) == last
    unsign(spark, root)
    file_signatures(pages).write.mode("overwrite").parquet(f"{root}/files")
    files = spark.read.parquet(f"{root}/files")
    old = spark.read.parquet(f"{state(path, last)}/files") if known else files.limit(0)
    same = files.join(old, ["source_file", "signature"], "left_semi").select("source_file")
    new = files.join(same, "source_file", "left_anti").select("source_file")
    chunks = packing.build_chunks(pages.join(new, "source_file", "left_semi"), window, **how)
    if known:
        stored = spark.read.schema(chunks.schema).parquet(f"{state(path, last)}/chunks").join(same, "source_file", "left_semi")
        chunks = chunks.unionByName(stored)
    chunks.write.mode("overwrite").partitionBy("doc_family").parquet(f"{root}/chunks")
    sign(spark, root, signed)
    return {"made": new.count(), "kept": same.count(), "gone": old.join(files, "source_file", "left_anti").count()}


def sign(spark: SparkSession, path: str, value: str) -> None:
    """Signs what stands under path, as the last step of a build."""
    spark.range(1).select(F.lit(value).alias("value")).write.mode("overwrite").text(f"{path}/signature")


def unsign(spark: SparkSession, path: str) -> None:
    _delete(spark, f"{path}/signature")


def stored_signature(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(f"{path}/signature").first()
    except AnalysisException:
        return None
    return row[0].strip() if row else None


def is_valid(spark: SparkSession, path: str, signed: str) -> bool:
    """Is there a state signed so, and not empty? Anything unreadable counts as absent."""
    root = state(path, signed)
    if stored_signature(spark, root) != signed:
        return False
    try:
        return not spark.read.parquet(f"{root}/chunks").isEmpty()
    except AnalysisException:
        return False


def ensure(chunks: DataFrame, path: str, signed: str) -> bool:
    """Builds the state if it isn't valid; True if it built."""
    if is_valid(chunks.sparkSession, path, signed):
        return False
    build(chunks, path, signed)
    return True


def open_index(spark: SparkSession, path: str, signed: str) -> DataFrame:
    if not is_valid(spark, path, signed):
        raise FileNotFoundError(f"no index signed {signed} in {path}")
    return spark.read.parquet(f"{state(path, signed)}/chunks")


def refresh(spark: SparkSession, path: str, *opened: DataFrame) -> None:
    """Forgets what is cached of the index and of tables opened from it; never raises."""
    for table in opened:
        table.unpersist()
    try:
        spark.catalog.refreshByPath(path)
    except Exception:  # noqa: BLE001  a path that isn't there has nothing cached
        return


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
