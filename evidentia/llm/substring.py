"""Repeated word windows across documents, found by difference-cover anchors.

Of a document's words only those at positions p with p mod v in a difference cover
start an anchor, a run of w = window - v + 1 words.  For any two places of an equal window
some shift below v brings both onto cover positions, so the two share an anchor at
the same offset.  Windows that hold no repeated anchor can't repeat; the others
are extended to the full window and the first of each kind is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _blocks as K
from . import _bytes as B
from ._scratch import Scratch

_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("h1", "h2", "at", "doc_at", "ids"))])


def difference_cover(window: int) -> tuple[int, list[int]]:
    """(v, cover): a period and residues such that each difference modulo v is one of two residues.

    The largest period q*q + q + 1 (q a prime) that leaves anchors of at least a third of the window, with a perfect
    difference set found by search; period 1 (every position) for windows too short for any.
    """
    best = (1, [0])
    for q in (2, 3, 5):
        v = q * q + q + 1
        if window - v + 1 < max(2, window // 3):
            break
        best = (v, _perfect(v, q + 1))
    return best


def _perfect(v: int, size: int) -> list[int]:
    def grow(chosen: list[int], used: set[int]) -> list[int] | None:
        if len(chosen) == size:
            return chosen
        for x in range(chosen[-1] + 1, v):
            new = {d for c in chosen for d in ((x - c) % v, (c - x) % v)}
            if len(new) == 2 * len(chosen) and not new & used and (out := grow([*chosen, x], used | new)):
                return out
        return None

    return grow([0], set())


class _Words:
    def __init__(self, b: K.Block, window: int, v: int, cover: list[int]):
        starts, ends, self.first = B.words(b.data, b.offsets)
        self.hash = B.span_hashes(b.data, starts, ends)
        self.other = lambda: B.span_hashes(b.data, starts, ends, salt=1)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(b)), self.n)
        self.width = window - v + 1
        place = np.arange(len(starts)) - self.first[self.doc]
        chosen = np.zeros(v, dtype=bool)
        chosen[cover] = True
        self.anchors = np.flatnonzero(chosen[place % v] & (place + self.width <= self.n[self.doc]))
        runs = B.window_hashes(self.hash, self.width)
        self.keys = runs[self.anchors] if self.anchors.size else np.zeros(0, np.uint64)


def dedup_windows(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input rows, all columns, with the text cut down, plus n_words, n_removed and kept_sha256.

    Removes each word covered by a `window`-word run that also starts earlier: in a row
    with a smaller id, or earlier in the same row.  Runs are judged on the input.  Words are
    maximal runs of other bytes than ASCII white space, taken unchanged.  Where words go, the
    kept ones are joined by one space; a text that loses none stays as it is.
    kept_sha256 is always that of the kept words joined by one space.

    A null text has no words and stays null; an empty or blank one stays. Rows with a null id come before
    all others; rows that share an id rank as they are stored, so of repeated rows one
    stays whole.  Other columns pass through; those named as one of the added are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    v, cover = difference_cover(window)
    rows = K.blocks(docs, scratch, text_col)
    n_bytes = rows.agg(F.sum("n_bytes")).first()[0] or 0
    n = K.bucket_count(n_bytes / 6 * len(cover) / v, scratch)
    seen = K.repeated(rows, scratch, lambda b: _Words(b, window, v, cover).keys, n, id_col, text_col)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sent in K.each(batches, id_col, text_col):
            w = _Words(b, window, v, cover)
            again, _ = K.flagged(w.keys, n, sent)
            p = w.anchors[again]
            lo = np.maximum(p - v + 1, w.first[w.doc[p]])
            hi = np.minimum(p, w.first[w.doc[p]] + w.n[w.doc[p]] - window)
            ok = hi >= lo
            mark = np.zeros(len(w.hash) + 1, dtype=np.int32)
            np.add.at(mark, lo[ok], 1)
            np.add.at(mark, hi[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            if not at.size:
                continue
            h1, h2 = B.window_hashes(w.hash, window)[at], B.window_hashes(w.other(), window, salt=1)[at]
            out, later = K.window_rows(b, n, 1, at, w.doc[at], w.first[:-1], h1, h2)
            if later.size:
                out.append((0, b.block % n, b.block, None, None, later.astype(np.uint32).tobytes(), None, None))
            yield K.batch_of(out, _SENT)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in K.by_bucket(batches, ["block", "h1", "h2", "at", "doc_at", "ids", "kind"]):
            later = K.later_windows([r[:6] for r in rows if r[6] == 1]) + [(r[0], r[3]) for r in rows if r[6] == 0]
            yield K.places_out([(block, at, window) for block, at in later])

    sent = K.with_sent(rows, seen).mapInArrow(B.tidy(extend), K.WINDOWS)
    late = scratch.table("late", K.exchange(sent, n).mapInArrow(B.tidy(meet), K.PLACES))
    scratch.drop("repeated")
    scratch.sweep()
    names = docs.columns
    t = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sent in K.each(batches, id_col, text_col):
            _, _, first = B.words(b.data, b.offsets)
            gone = np.zeros(int(first[-1]) + 1, dtype=np.int32)
            for r in sent:
                at = np.frombuffer(r["places"], np.uint32)
                gone[at] += 1
                gone[at + window] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            kept_n = np.concatenate([[0], np.cumsum(keep)])[first]
            n_words, n_removed = np.diff(first), np.diff(first) - np.diff(kept_n)
            texts, digests, old = [], [], b.text.to_pylist()
            for i in range(len(b)):
                ws = b.raw(i).split()
                if n_removed[i]:
                    ws = list(compress(ws, keep[first[i] : first[i + 1]].tolist()))
                joined = b" ".join(ws)
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if n_removed[i] else old[i])
            cols = list(b.rows.columns)
            cols[t] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words), pa.array(n_removed), pa.array(digests, pa.string())], names=[*names, "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    late = late.groupBy("block").agg(F.collect_list(F.struct("places")).alias("sent"))
    return K.with_sent(rows, late).mapInArrow(B.tidy(cut), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_windows(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, CAST(u.i AS BIGINT) AS i, ws[u.i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
g AS (SELECT doc_id, u.i AS i, md5(array_to_string(ws[u.i:u.i + 19], ' ')) AS h FROM w, unnest(range(1, len(ws) - 18)) AS u(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS late FROM g),
l AS (SELECT doc_id, i, max(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM (
  SELECT p.doc_id, p.i, coalesce(r.late, false) AS late FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i)),
k AS (SELECT p.doc_id, p.i, p.word, coalesce(p.i - l.last < 20, false) AS gone FROM p JOIN l ON p.doc_id = l.doc_id AND p.i = l.i)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY 1) x ON w.doc_id = x.doc_id
"""
