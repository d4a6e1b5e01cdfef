"""Blocks of documents, and two exchanges by hash between them that ship arrays rather than rows.

Finding what repeats across a corpus needs a look at every window of every
document.  A row a window would drown the shuffle, so documents are first written as
blocks (a few MB of text in one row).  A block sends each bucket of the hash
space one row with a sorted array of its distinct hashes; a bucket answers each block
with one row.  What repeats inside a block, also one that a third of all documents
share, is sent once by that block: no bucket grows with a hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import Scratch

#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Hashes in a bucket, about, and tasks of an exchange at most: beyond that a task takes several buckets, one after the other.
BUCKET, TASKS = 3_000_000, 8192
#: Bytes of text that one task of a join reads, about.
JOIN_BYTES = 64 << 20
#: A key with more contexts than this, over all blocks, is hot.
HOT = 1024
#: Stands for a null id: before all others.
NO_ID = np.iinfo(np.int64).min


def pack(batch: pa.RecordBatch) -> bytes:
    """Rows as one compressed Arrow stream: a third of their size in a shuffle, and nothing that the JVM has to look into."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def blocks(docs: DataFrame, scratch: Scratch, text_col: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Table (block, n_bytes, rows): `rows` holds whole rows of docs, packed, of about `size` bytes of text; a longer text has a block of its own."""
    at = docs.columns.index(text_col)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = B.flat(batch.column(at))
            for i, j in B.cuts(offsets, size):
                # take, not slice: a slice would carry the buffers of the whole batch
                part = batch.take(pa.array(np.arange(i, j)))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(offsets[j] - offsets[i])]), pa.array([pack(part)], pa.binary())], names=["block", "n_bytes", "rows"])
                block += 1

    # how many tasks a join gets follows from Spark's estimate of the rows' size; a wrong one changes no result
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = usual if guess >= 1 << 60 else min(max(guess // JOIN_BYTES, usual), 64 * usual, 20_000)  # rows that Spark knows no size of count as 8 EB
    return scratch.bucketed("blocks", docs.mapInArrow(B.tidy(gather), "block bigint, n_bytes bigint, rows binary"), "block", n)


class Block:
    """One block in Python: its rows, their ids, and their texts as one byte buffer."""

    def __init__(self, block: int, packed: bytes, id_col: str, text_col: str):
        self.block = block
        self.rows = pa.ipc.open_stream(packed).read_next_batch()
        self.text = self.rows.column(self.rows.schema.get_field_index(text_col))
        self.data, self.offsets = B.flat(self.text)
        self.ids = self.rows.column(self.rows.schema.get_field_index(id_col)).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def raw(self, t: int) -> bytes:
        return self.data[self.offsets[t] : self.offsets[t + 1]].tobytes()


def each(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[tuple[Block, list[dict]]]:
    """Blocks, with what was joined to them under the name `sent` (a list of structs)."""
    for batch in batches:
        at = [batch.schema.get_field_index(c) for c in ("block", "rows", "sent")]
        for i in range(batch.num_rows):
            sent = batch.column(at[2])[i].as_py() if at[2] >= 0 else None
            yield Block(batch.column(at[0])[i].as_py(), batch.column(at[1])[i].as_buffer(), id_col, text_col), sent or []


def bucket_count(units: float, scratch: Scratch) -> int:
    return max(int(units / BUCKET) + 1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Grows with the key, so that sorted keys are dealt in runs."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts_of(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(bucket, where its keys lie) of sorted keys, for each bucket that has some."""
    buckets, first = np.unique(bucket_of(keys, n), return_index=True)
    for k, i, j in zip(buckets.tolist(), first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True):
        yield k, slice(i, j)


def exchange(sent: DataFrame, n: int) -> DataFrame:
    """Rows with a `bucket` below n, dealt in ranges of buckets to at most TASKS tasks, in order of buckets."""
    tasks = min(n, TASKS)
    return sent.repartitionById(tasks, F.floor(F.col("bucket") * F.lit(tasks) / F.lit(n)).cast("int")).sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each bucket, with these columns, of batches in order of buckets: one bucket is held at a time."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            if held and bucket[i] != now:
                yield held
                held = []
            now = bucket[i]
            part = batch.slice(i, j - i)
            held += zip(*(part.column(c).to_pylist() for c in columns), strict=True)
    if held:
        yield held


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def repeated(blocks: DataFrame, scratch: Scratch, keys: Callable[[Block], np.ndarray], n: int, id_col: str, text_col: str, name: str = "repeated", contexts: Callable[[Block], np.ndarray] | None = None) -> DataFrame:
    """Table (block, sent): for each block, which of its distinct keys other blocks hold too, and which are hot.

    `contexts` gives, for each key of a block, a number that tells its contexts apart; without it a block has one context a key.

    A filter: it tells keys apart by about 32 bits within their bucket, so a few keys in a
    thousand are named in vain; none that repeats is missed.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in each(batches, id_col, text_col):
            all_ = keys(b)
            if contexts is None:
                u, many = np.unique(all_), None
            else:
                every = all_[np.unique(B.join(all_, contexts(b)), return_index=True)[1]]
                u, many = np.unique(every, return_counts=True)
                many = np.minimum(many, 0xFFFF).astype(np.uint16)
            if not u.size:
                continue
            low = u.astype(np.uint32)
            cut = list(cuts_of(u, n))
            # one context is the rule: then no counts are sent
            counts = [None if many is None or (many[s] == 1).all() else _pack(many[s]) for _, s in cut]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array(np.full(len(cut), b.block)), pa.array([_pack(low[s]) for _, s in cut], pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "block", "keys", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches, ["bucket", "block", "keys", "counts"]):
            yield from answer(rows)

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(r[2], np.uint32) for r in rows]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        all_ = np.concatenate(parts).astype(np.uint64) | np.repeat(np.array([r[0] for r in rows], np.uint64), np.diff(at)) << np.uint64(32)
        order = np.argsort(all_)
        s = all_[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        seen = np.empty(len(s), dtype=np.int64)
        seen[order] = np.repeat(size, size)
        counts = np.concatenate([np.ones(len(p), np.int64) if r[3] is None else np.frombuffer(r[3], np.uint16) for p, r in zip(parts, rows, strict=True)])
        heat = np.empty(len(s), dtype=np.int64)
        heat[order] = np.repeat(np.add.reduceat(counts[order], start), size)
        out = []
        for i, (bucket, block, *_) in enumerate(rows):
            again, hot = seen[at[i] : at[i + 1]] > 1, heat[at[i] : at[i + 1]] > HOT
            if again.any() or hot.any():
                out.append((block, bucket, _pack(np.packbits(again)), _pack(np.packbits(hot)) if hot.any() else b""))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.binary())], names=["block", "bucket", "bits", "hot"])

    sent = exchange(blocks.mapInArrow(B.tidy(send), "bucket int, block bigint, keys binary, counts binary"), n)
    back = scratch.table(name, sent.mapInArrow(B.tidy(meet), "block bigint, bucket int, bits binary, hot binary"))
    scratch.sweep()
    return back.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("sent"))


def flagged(keys: np.ndarray, n: int, sent: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """For each key of a block: does it repeat, here or elsewhere; is it hot."""
    u, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    again, hot = count > 1, np.zeros(len(u), dtype=bool)
    where = dict(cuts_of(u, n))
    for r in sent:
        a, b = where[r["bucket"]].start, where[r["bucket"]].stop
        again[a:b] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
        if r["hot"]:
            hot[a:b] |= np.unpackbits(np.frombuffer(r["hot"], np.uint8), count=b - a).astype(bool)
    return again[inverse], hot[inverse]


def doc_order(b: Block, doc: np.ndarray) -> np.ndarray | None:
    """Order that sorts places, given by their text in the block, by the texts' ids; None if they are in order."""
    if (b.ids[1:] >= b.ids[:-1]).all():
        return None
    rank = np.empty(len(b), dtype=np.int64)
    rank[np.argsort(b.ids, kind="stable")] = np.arange(len(b))
    return np.argsort(rank[doc], kind="stable")


def first_here(b: Block, at: np.ndarray, doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows at ascending places: indices of the first of each kind, sorted by h1, and of the others."""
    order = doc_order(b, doc)
    order = np.arange(len(at)) if order is None else order
    order = order[np.argsort(h1[order], kind="stable")]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    return order[new], order[~new]


WINDOWS = "kind int, bucket int, block bigint, h1 binary, h2 binary, at binary, doc_at binary, ids binary"


def window_rows(b: Block, n: int, kind: int, at: np.ndarray, doc: np.ndarray, doc_start: np.ndarray, h1: np.ndarray, h2: np.ndarray, every: bool = False) -> tuple[list, np.ndarray]:
    """Rows that send a block's first windows of each kind (or all of them) to their buckets, and the places of windows that an earlier one in the block covers."""
    first, later = first_here(b, at, doc, h1, h2)
    if every:
        first = np.argsort(h1, kind="stable")
    h1s, h2s, ats, docs = h1[first], h2[first].astype(np.uint32), at[first], doc[first]
    rows = []
    for k, s in cuts_of(h1s, n):
        d = np.unique(docs[s])
        rows.append((kind, k, b.block, _pack(h1s[s]), _pack(h2s[s]), _pack(ats[s].astype(np.uint32)), _pack(doc_start[d].astype(np.uint32)), _pack(b.ids[d])))
    return rows, at[later]


#: Columns of what buckets send back to blocks.
PLACES = "block bigint, places binary, size int"
_PLACES = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("size", pa.int32())])


def later_windows(rows: list[tuple]) -> list[tuple[int, bytes]]:
    """(block, places) of the windows in rows (block, h1, h2, at, doc_at, ids) of which an equal one starts earlier in another block: a smaller id, or the same id in an earlier block."""
    if not rows:
        return []
    h1 = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
    h2 = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    at = [np.frombuffer(r[3], np.uint32) for r in rows]
    ids = np.concatenate([np.frombuffer(r[5], np.int64)[np.searchsorted(np.frombuffer(r[4], np.uint32), a, side="right") - 1] for r, a in zip(rows, at, strict=True)])
    size = np.array([len(a) for a in at])
    block = np.repeat(np.array([r[0] for r in rows]), size)
    order = np.lexsort((block, ids, h2, h1))
    late = np.zeros(len(order), dtype=bool)
    late[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    ends = np.cumsum(size)
    return [(r[0], _pack(a[late[e - len(a) : e]])) for r, a, e in zip(rows, at, ends.tolist(), strict=True) if late[e - len(a) : e].any()]


def places_out(rows: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_PLACES)], schema=_PLACES)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def with_sent(blocks: DataFrame, sent: DataFrame) -> DataFrame:
    return blocks.join(sent, "block", "left")
