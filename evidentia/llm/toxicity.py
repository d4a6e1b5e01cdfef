"""Toxicity scores from a factorization machine over hashed terms.

score = sigmoid(b + sum w[t] + sum over pairs <v[s], v[t]>) over the distinct terms of a
text: the pair terms let an insult weigh more beside another word, which additive
weights can't.  Fitted on a bounded sample of labelled rows; applied to every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes as B
from ._scratch import Scratch

#: Bits of a term's hash.
BITS = 20
#: Bytes at a word's start that are terms too.
STEMS = (4, 5)
#: Words of a text that share a stem are told apart up to so many.
MANY = 3
#: How many standard deviations a term's share of class 1 must lie from that of all terms, for the machine to weigh it.
TELLS = 2.0
#: Terms in this share of the rows are weighed whatever they tell by themselves: a pair of them may tell what neither does.
COMMON = 0.2
#: How much harder factors are held down than single weights: pairs are many.
FIRMER = 10
#: Labelled rows that the machine is fitted on, at most.
LABELLED = 16_000
#: Steps of fitting, at least: few rows are gone through more often.
STEPS = 500
#: Bytes of text worked on at one time.
CHUNK = 1 << 20

_SEPARATES = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _SEPARATES[_c] = 0x20
_SEPARATES[0x41:0x5B] += 0x20


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of each text, in order, and where each text's begin.

    A term is a run of letters, digits and bytes beyond ASCII, A-Z lowered, or the first bytes of a longer one (STEMS): words of one stem share them.
    That two or three different words of a text share a stem (up to MANY) is a term of its own: by chance one does, in a text about it several do.
    """
    data = _SEPARATES[data]
    starts, ends, first = B.words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first)) << np.uint64(32)
    short = np.uint64(64 - BITS)
    full = B.span_hashes(data, starts, ends)
    _, one = np.unique(doc | full >> np.uint64(32), return_index=True)
    one.sort()
    doc, starts, ends = doc[one], starts[one], ends[one]
    every = [doc | full[one] >> short]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        stem = B.mix(B.span_hashes(data, starts[long], starts[long] + n) + np.uint64(n))
        which, at, count = np.unique(doc[long] | stem >> np.uint64(32), return_index=True, return_counts=True)
        for m in range(1, MANY + 1):
            often = at[count >= m]
            every.append(which[count >= m] & np.uint64(0xFFFFFFFF00000000) | B.mix(stem[often] + np.uint64(m << 40)) >> short)
    u = np.unique(np.concatenate(every))
    return (u & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(u >> np.uint64(32), np.arange(len(offsets)))


@dataclass(frozen=True)
class Machine:
    """Terms with a weight, in order; all others count nothing."""

    bias: float
    known: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def raw(self, t: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log odds of texts whose terms are t[at[i]:at[i+1]]."""
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        if not len(self.known):
            return np.full(n, self.bias)
        i = np.minimum(np.searchsorted(self.known, t), len(self.known) - 1)
        hit = self.known[i] == t
        i, row = i[hit], row[hit]
        out = self.bias + np.bincount(row, self.weight[i], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[i, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(t: np.ndarray, at: np.ndarray, y: np.ndarray, *, factors: int = 4, rounds: int = 12, least: int = 4, tells_from: float = TELLS, common: float = COMMON, rate: float = 0.1, decay: float = 3e-3, how_even: float = 1.0, batch: int = 256, seed: int = 11) -> Machine:
    """Adagrad on the log loss. Terms in fewer than `least` rows are left out, and rarer ones (than the share `common`) that by themselves hardly tell the classes apart (`tells_from`); `how_even` 1 gives both classes the same weight, 0 each row."""
    y = y.astype(np.float64)
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else np.clip(y.mean(), 1e-3, 1 - 1e-3)
        none = np.zeros(0)
        return Machine(float(np.log(p / (1 - p))), none.astype(np.int64), none, np.zeros((0, factors)))
    # counts over all hashes, a slice of the terms at a time: memory stays that of the terms themselves
    count, pos = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS)
    docs = [(i, min(i + 500, len(y))) for i in range(0, len(y), 500)]
    row_of = lambda i, j: np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
    for i, j in docs:
        part = t[at[i] : at[j]]
        count += np.bincount(part, minlength=1 << BITS)
        pos += np.bincount(part, y[row_of(i, j)], 1 << BITS)
    share = pos.sum() / max(count.sum(), 1)
    tells = np.abs(pos - count * share) / np.sqrt(count * share * (1 - share) + 1e-9)
    keep = (count >= least) & ((tells >= tells_from) | (count >= common * len(y)))
    known = np.flatnonzero(keep)
    renumber = np.cumsum(keep, dtype=np.int32) - 1
    picked = [(renumber[part[keep[part]]], row_of(i, j)[keep[part]]) for i, j in docs for part in [t[at[i] : at[j]]]]
    cols = np.concatenate([c for c, _ in picked])
    at = np.searchsorted(np.concatenate([r for _, r in picked]), np.arange(len(y) + 1))
    del picked, count, pos, tells, renumber
    p = y.mean()
    rng = np.random.default_rng(seed)
    w = np.zeros(len(known))
    v = rng.normal(0, 0.01, (len(known), factors))
    bias, gb, gw, gv = float(np.log(p / (1 - p))), 1e-8, np.full(len(known), 1e-8), np.full(v.shape, 1e-8)
    lift = ((1 - p) / p) ** how_even
    for _ in range(max(rounds, -(-STEPS * batch // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            docs = order[k : k + batch]
            i = cols[B.ranges(at[docs], at[docs + 1] - at[docs])]
            r = np.repeat(np.arange(len(docs)), at[docs + 1] - at[docs])
            u, j = np.unique(i, return_inverse=True)
            vu, wu = v[u], w[u]
            sums = np.stack([np.bincount(r, vu[j, f], len(docs)) for f in range(factors)], 1)
            squares = np.bincount(r, (vu * vu).sum(1)[j], len(docs))
            z = bias + np.bincount(r, wu[j], len(docs)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (sigmoid(z) - y[docs]) * np.where(y[docs] > 0, lift, 1.0) / len(docs)
            gj = g[r]
            dw = np.bincount(j, gj, len(u)) + decay * wu
            dv = np.stack([np.bincount(j, gj * (sums[r, f] - vu[j, f]), len(u)) for f in range(factors)], 1) + FIRMER * decay * vu
            gw[u] += dw**2
            gv[u] += dv**2
            gb += g.sum() ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
            bias -= rate * g.sum() / np.sqrt(gb)
    return Machine(bias, known, w, v)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = B.flat(batch.column(0))
        for i, j in B.cuts(offsets, CHUNK):
            t, at = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            packed = [t[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), pa.array(packed, pa.binary()), batch.column(1).slice(i, j - i)], names=["id", "terms", "label"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED, **how) -> Machine:
    """Fits on at most `most` labelled rows (picked by hash of the id), texts whole. Rows with a null id or label are passed over; of rows that share an id the one with the least hash of its terms counts, so `most` rows come to the driver at most; an id labelled both ways counts as it does for most rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    n = known.count()
    if n > most:
        # the sample follows a hash, so a fit can be repeated; a little more is taken, for the order of the hash to cut at `most`
        share = int((1 << 30) * min(1.0, most / n + 4 * (most**0.5) / n))
        known = known.where(F.pmod(F.xxhash64(id_col, F.lit(13)), F.lit(1 << 30)) < share).orderBy(F.pmod(F.xxhash64(id_col, F.lit(13)), F.lit(1 << 30)), id_col).limit(most)
    texts = docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    hashed = texts.join(F.broadcast(known), id_col).select("text", "label", F.col(id_col).cast("string").alias("id")).mapInArrow(B.tidy(_hashed), "id string, terms binary, label int")
    hashed = Scratch(docs.sparkSession, "toxicity").table("terms", hashed.withColumns({"hash": F.xxhash64("terms"), "place": F.monotonically_increasing_id()}))
    # one row an id; what is grouped and sent is a number an id
    one = hashed.groupBy("id").agg(F.min(F.struct("hash", "place")).alias("m")).select(F.col("m.place").alias("place"))
    got = hashed.join(F.broadcast(one), "place", "left_semi").select("terms", "label").toArrow()
    packed, labels_ = got.column("terms").to_pylist(), got.column("label").to_numpy()
    del got
    order = sorted(range(len(packed)), key=packed.__getitem__)
    at = np.concatenate([[0], np.cumsum([len(packed[i]) // 4 for i in order])]).astype(np.int64)
    return fit(np.frombuffer(b"".join(packed[i] for i in order), np.int32), at, labels_[order].astype(np.float64) if order else np.zeros(0), **how)


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """Input rows, all columns, plus score (0 to 1). A null, empty or blank text scores as one without known terms. A column named score is replaced."""
    docs = docs.drop("score")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the terms of the sample

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.flat(batch.column(at))
            parts = [sigmoid(shared.value.raw(*terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))) for i, j in B.cuts(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*parts, np.zeros(0)]))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(B.tidy(apply), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    machine = train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
