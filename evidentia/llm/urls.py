"""Verdicts on URLs: allow and block rules first, gradient-boosted trees over lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Labelled rows that the trees are fitted on, at most.
LABELLED = 20_000
#: Folds that the suffix statistics of fitted rows are taken out of.
FOLDS = 5
#: Rules of the query, action and host with path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
FEATURES = ["f_length", "f_host", "f_labels", "f_depth", "f_path", "f_digits", "f_entropy", "f_params", "f_query", "f_hyphens", "f_fragment", "f_suffix", "f_suffix_rows"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lowered. Path: then up to ?, # or end. Both empty for null or without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(action, rule) of the longest rule that fits, or null; of equally long ones the blocking one."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    parts = F.transform(F.filter(F.array_distinct(chars), lambda c: c != ""), lambda c: -share(c) * F.log2(share(c)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def features(rows: DataFrame) -> DataFrame:
    """Adds lexical columns to (url, host, path). A null url counts as empty."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    return rows.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_labels": count(F.col("host"), "."),
        "f_depth": count(F.col("path"), "/"),
        "f_path": F.length("path").cast("double"),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)).cast("double"),
        "f_entropy": entropy(url),
        "f_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "f_query": F.length(query).cast("double"),
        "f_hyphens": count(url, "-"),
        "f_fragment": F.when(F.contains(url, F.lit("#")), 1.0).otherwise(0.0),
        "suffix": F.substring_index("host", ".", -1),
    })


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], *, most: int = LABELLED, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    `labels` (url, label 1 to block) are the URLs to learn from; without it, those of `pages` that a rule decides are.
    At most `most` are used to fit the trees, picked by hash; shares and counts of suffixes are over all, for a row that is fitted over all but the fifth that it is in.  The longest rule that fits
    decides; where none fits, the trees' probability of block at 0.5.  If the labels, or those picked, show one class only, the share of
    block among all labels decides; without labels all is allowed.

    Null and malformed URLs have an empty host and path, fit no rule and are judged by their lexical features; rows with a null id and
    repeated rows are judged like others; other columns are ignored.

    All columns are built-in expressions; the trees are JVM code on DataFrames.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules)).select("*", F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action")).drop("hit")
    rows = features(rows)
    if labels is None:
        known = rows.where("rule is not null").withColumn("label", (F.col("action") == "block").cast("double"))
    else:
        own = labels.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
        known = features(own.withColumn("host", host).withColumn("path", path))
    fold = F.pmod(F.xxhash64("url", F.lit(29)), F.lit(FOLDS)).cast("int")
    known = known.select("url", "label", "suffix", fold.alias("fold"), *FEATURES[:-2])
    counts = scratch.table("counts", known.groupBy("suffix", "fold", "label").agg(F.count("*").alias("n")))
    classes = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(classes.values())
    share = classes.get(1.0, 0) / total if total else 0.0
    n, bad = F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("bad")
    smooth = lambda bad, n: ((bad + 4 * share) / (n + 4)).alias("f_suffix")
    every = scratch.table("every", counts.groupBy("suffix").agg(n, bad))
    stats = every.select("suffix", smooth(F.col("bad"), F.col("n")), F.log2(F.col("n") + F.lit(1.0)).alias("f_suffix_rows"))
    # a row that is fitted must not see its own label: its suffix counts without the fold that it is in
    mine = counts.groupBy("suffix", "fold").agg(F.sum("n").alias("m"), F.sum(F.col("label") * F.col("n")).alias("mb"))
    apart = mine.join(every, "suffix").select("suffix", "fold", smooth(F.col("bad") - F.col("mb"), F.col("n") - F.col("m")), F.log2(F.col("n") - F.col("m") + F.lit(1.0)).alias("f_suffix_rows"))
    if total > most:
        # picked by hash, so a fit can be repeated; a little more is taken, for the order of the hash to cut at `most`
        place = F.pmod(F.xxhash64("url", F.lit(19)), F.lit(1 << 30))
        known = known.where(place < int((1 << 30) * min(1.0, most / total + 4 * most**0.5 / total))).orderBy(place, "url", "label").limit(most)
    known = scratch.table("known", known.drop("url"))
    add = lambda df, by, on: df.join(by, on, "left").fillna({"f_suffix": share, "f_suffix_rows": 0.0})
    if len(classes) < 2 or known.select("label").distinct().count() < 2:
        scored = rows.withColumn("score", F.lit(share))
    else:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees: GBTClassificationModel = GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, maxBins=32, seed=23, checkpointInterval=-1).fit(vector.transform(add(known, apart, ["suffix", "fold"])))
        scored = trees.transform(vector.transform(add(rows.drop("label"), stats, ["suffix"]))).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
