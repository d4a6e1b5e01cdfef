"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two values of the signature, its
minimum and its maximum, so half the permutations make a signature of the same
length.  Signatures are cut into bands; documents that agree on a band are
candidates, and each link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._components import components, extend
from ._scratch import Scratch

#: Bytes of text worked on at one time.
CHUNK = 1 << 20
#: Documents compared with one another in one block of an unsettled bucket.
BLOCK = 64
#: Open buckets of more members than this get ROUNDS further stars, each with about CENTRES centres, before all blocks meet.
LARGE, ROUNDS, CENTRES = 16, 1, 8


def bands_for(threshold: float, values: int, miss: float = 1e-6) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the threshold with probability `miss` at most."""
    for rows in range(12, 0, -1):
        bands = values // rows
        if (1 - threshold**rows) ** bands <= miss:
            return rows, bands
    return 1, values


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    data = B.lower_ascii(data)
    starts, ends, first = B.words(data, offsets)
    word = B.span_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(count, out=at[1:])
    out = np.empty(at[-1], dtype=np.uint64)
    whole = n >= k
    if whole.any():
        out[B.ranges(at[:-1][whole], count[whole])] = B.window_hashes(word, k)[B.ranges(first[:-1][whole], count[whole])]
    for short in range(1, k):
        if (t := np.flatnonzero(n == short)).size:
            out[at[t]] = B.window_hashes(word, short, salt=short)[first[t]]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][count > 0]] = True
    upto = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum(new, out=upto[1:])
    return out[new], upto[at]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = B.flat(batch.column(1))
        for i, j in B.cuts(offsets, CHUNK):
            yield batch.column(0).slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _per_text(values: np.ndarray, at: np.ndarray, fold: np.ufunc, full: np.ndarray) -> np.ndarray:
    return fold.reduceat(values, at[:-1][full])


def _signer(k: int, permutations: int, rows: int, bands: int):
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 1 << 32, permutations, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _texts(batches):
            sets, at = shingle_sets(data, offsets, k)
            n = np.diff(at)
            full = n > 0
            digest = np.zeros((2, len(n)), dtype=np.uint64)
            sig = np.zeros((len(n), 2 * permutations), dtype=np.uint32)
            if full.any():
                digest[0, full] = _per_text(B.mix(sets + np.uint64(1)), at, np.add, full)
                digest[1, full] = _per_text(B.mix(sets ^ np.uint64(0x5555555555555555)), at, np.add, full)
                x = (sets >> np.uint64(32)).astype(np.uint32)
                v = np.empty_like(x)
                for p in range(permutations):
                    np.multiply(x, mult[p], out=v)
                    np.add(v, add[p], out=v)
                    sig[full, p] = _per_text(v, at, np.minimum, full)
                    sig[full, permutations + p] = _per_text(v, at, np.maximum, full)
            keys = np.empty((len(n), bands), dtype=np.uint64)
            for b in range(bands):
                key = np.full(len(n), b + 1, dtype=np.uint64)
                for c in range(b * rows, (b + 1) * rows):
                    key = B.mix(key * np.uint64(3) + sig[:, c])
                keys[:, b] = key
            keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32), pa.array(keys[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), keys], names=["doc_id", "n_shingles", "d1", "d2", "keys"])

    return sign


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _texts(batches):
            flat, at = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(at.astype(np.int32), pa.array(flat.view(np.int64)))], names=["id", "set"])

    return sets


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose sets reach num / den of their union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(inter * (den + num) >= num * (F.size("sa") + F.size("sb"))).select("a", "b")


def _block_linker(num: int, den: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, labels = table.column("rep").to_numpy(), table.column("label").to_numpy()
        side, sets = table.column("block").to_numpy(), [np.asarray(x.values) for x in table.column("set")]
        left, right = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        root = {x: x for x in labels.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i in np.flatnonzero(side == left).tolist():
            for j in np.flatnonzero(side == right).tolist():
                if left == right and j <= i or find(labels[i]) == find(labels[j]) or ids[i] == ids[j]:
                    continue
                n, m = len(sets[i]), len(sets[j])
                if min(n, m) * den < max(n, m) * num:
                    continue
                if np.intersect1d(sets[i], sets[j], assume_unique=True).size * (den + num) >= num * (n + m):
                    root[find(labels[i])] = find(labels[j])
                    found.append((ids[i], ids[j]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return link


def _open(members: DataFrame, label: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Table (k, rep, label, own, inner, outer) of what buckets leave open whose members, the centre aside, are of several groups so far.

    Buckets with the same largest group are merged, for a hot group has many buckets with almost the same members; k is
    that group, own says whether a member is of it, inner and outer count those that are and those that aren't.
    """
    rest = members.where("rep <> c").join(label, F.col("rep") == F.col("node"), "left").select("k", "rep", F.coalesce("root", "rep").alias("label"))
    rest = scratch.table(f"{tag}-rest", rest)
    sign = F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sign")
    # what is summed up by bucket or group is written before it meets the members: Spark can then split a hot key of the join
    several = rest.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), sign).where("lo < hi")
    several = scratch.table(f"{tag}-several", several.groupBy("n", "sign").agg(F.min("k").alias("k")).select("k"))
    live = scratch.table(f"{tag}-live", rest.join(several, "k"))
    sizes = live.groupBy("k", "label").agg(F.count("*").alias("n"))
    main = scratch.table(f"{tag}-main", sizes.groupBy("k").agg(F.max(F.struct("n", "label"))["label"].alias("main")))
    merged = scratch.table(f"{tag}-merged", live.join(main, "k").select(F.col("main").alias("k"), "rep", "label", (F.col("label") == F.col("main")).alias("own")).distinct())
    count = scratch.table(f"{tag}-count", merged.groupBy("k").agg(F.count_if("own").alias("inner"), F.count_if(~F.col("own")).alias("outer")))
    out = merged.join(count, "k")
    return scratch.table(f"{tag}-open", out)


def _more_stars(live: DataFrame, tag: int) -> DataFrame:
    """Pairs (a, b) of each outer member of a large open bucket with a few members of the largest group, picked by hash: a number that grows as the members do."""
    large = live.where(F.col("inner") + F.col("outer") > LARGE)
    chosen = F.pmod(F.xxhash64("rep", F.lit(tag)), F.col("inner")) < CENTRES
    centres = large.where(F.col("own") & chosen).select("k", F.col("rep").alias("a"))
    outer = large.where(~F.col("own")).select("k", F.col("rep").alias("b"))
    return outer.join(centres, "k").where("a <> b").select("a", "b").distinct()


def _rest(live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The remaining links of open buckets, exactly.

    An open bucket's largest group and its other members are dealt into blocks by hash.
    Each block of others meets each block in a task of its own, which passes
    over pairs of one group and returns a forest, not all pairs.  No bucket size is too large for it.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    dealt = live.select("k", "rep", "label", "own", blocks(F.col("inner")).alias("bi"), blocks(F.col("outer")).alias("bo"))
    dealt = dealt.withColumn("block", F.when(F.col("own"), -1 - F.pmod(F.xxhash64("rep", F.lit(7)), F.col("bi"))).otherwise(F.pmod(F.xxhash64("rep", F.lit(7)), F.col("bo"))).cast("int"))
    others = F.when(F.col("own"), F.sequence(F.lit(0), F.col("bo") - 1)).otherwise(F.sequence(-F.col("bi"), F.col("bo") - 1))
    tasks = dealt.withColumn("other", F.explode(others)).select("k", "rep", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    full = tasks.join(sets.select(F.col("id").alias("rep"), "set"), "rep")
    return full.groupBy("k", "x", "y").applyInArrow(lambda t: pa.Table.from_batches(list(_block_linker(num, den)(t.to_batches()))), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: tuple[int, int] = (4, 5), permutations: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs of other bytes than ASCII white space, A-Z lowered;
    a document's set holds its distinct k-word shingles (its whole word sequence
    if it has fewer than k words).  Documents are linked when
    |A & B| >= threshold * |A | B|, a fraction (numerator, denominator);
    component_id is the smallest id reachable, kept says whether that is the row's own.

    Null, empty and blank texts have an empty set and link with nothing.  Rows with
    a null id keep a null component_id, are linked with nothing and are kept.
    Rows that share an id are one document.  Other columns are ignored.

    At scale: texts are read once for signatures and once for the sets of
    candidates.  Equal sets meet first, by a 128-bit digest, and go on as one.
    Candidates of a bucket are compared with its smallest member (as many pairs as
    members), large open buckets then with a few more; what that leaves open goes
    through _rest, block by block.
    """
    spark, (num, den) = docs.sparkSession, threshold
    scratch = Scratch(spark, "minhash")
    rows, bands = bands_for(num / den, 2 * permutations)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.table("signed", docs.mapInArrow(B.tidy(_signer(k, permutations, rows, bands)), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>"))
    reps = scratch.table("reps", signed.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # one row of keys for each distinct set
    keys = signed.select("doc_id", "d1", "d2", "keys").join(reps, ["d1", "d2"]).where("doc_id = rep").select("rep", F.explode("keys").alias("k"))
    keys = scratch.table("keys", keys)
    stars = scratch.table("stars", keys.groupBy("k").agg(F.min("rep").alias("c"), F.max("rep").alias("hi")).where("c < hi").select("k", "c"))
    members = scratch.table("members", keys.join(stars, "k"))
    scratch.drop("keys")
    pairs = members.where("rep <> c").select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = scratch.table("wanted", members.select(F.col("rep").alias("doc_id")).distinct())
    sets = scratch.table("sets", docs.join(wanted, "doc_id", "left_semi").mapInArrow(B.tidy(_sets(k)), "id bigint, set array<bigint>"))
    label = components(_confirm(pairs, sets, num, den), scratch, "cc-star-")
    live = _open(members, label, scratch, "open0")
    for r in range(1, ROUNDS + 1):
        if live.where(F.col("inner") + F.col("outer") > LARGE).isEmpty():
            break
        label = extend(label, _confirm(_more_stars(live, r), sets, num, den), scratch, f"cc{r}-")
        live = _open(members, label, scratch, f"open{r}")
    if not live.isEmpty():
        label = extend(label, scratch.table("rest", _rest(live, sets, num, den)), scratch, "cc-rest-")
    for name in ("sets", "members"):
        scratch.drop(name)
    joined = signed.select("doc_id", "n_shingles", "d1", "d2").join(reps.drop("copies"), ["d1", "d2"], "left").join(label, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, with all their columns; repeated rows of a kept id, and rows with a null id, all stay."""
    gone = near_duplicates(docs, id_col=id_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=3, threshold=(85, 100))


def expected_miss(threshold: float, permutations: int = 64) -> float:
    """Probability that a pair at the threshold shares no band."""
    rows, bands = bands_for(threshold, 2 * permutations)
    return math.pow(1 - threshold**rows, bands)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
d AS (SELECT md5(array_to_string(list_sort(sh), chr(10))) AS h, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY 1),
m AS (SELECT s.doc_id, d.rep FROM s JOIN d ON md5(array_to_string(list_sort(sh), chr(10))) = d.h WHERE len(sh) > 0),
x AS (SELECT s.doc_id, hash(u.g) AS g FROM s JOIN d ON s.doc_id = d.rep, unnest(s.sh) AS u(g)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n_shingles + nb.n_shingles - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rep, doc_id FROM m UNION SELECT doc_id, rep FROM m),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT n.doc_id, n_shingles, min(root) AS component_id, min(root) = n.doc_id AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""
