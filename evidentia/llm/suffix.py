"""Repeated byte strings across documents, from the common-prefix intervals of enhanced suffix arrays.

Every window of `length` bytes picks its least k-gram (k = 32) by hash, so equal
windows pick equal k-grams, and a block has about one pick in 35 bytes.
Picks that repeat send their context, all windows that chose them, to the bucket of the
k-gram, each different context once with all its places.  There a suffix array over the contexts of a k-gram is scanned
with a stack for intervals of common prefixes; those whose
occurrences differ in the byte before (or start a context) are the maximal repeats inside contexts, with
all their occurrences.  `repeat_groups` gives these; dedup removes all but the earliest occurrence of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _blocks as K
from . import _bytes as B
from ._scratch import Scratch

#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 18


# ---- enhanced suffix array ---------------------------------------------------


#: Bytes that the first ranks tell apart: as many as fit 63 bits, nine for a byte or an end.
FIRST = 7
#: Bytes of a k-gram.
GRAM = 32


def suffix_array(text: np.ndarray, ends: np.ndarray, least: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of `least` bytes or more of several texts in one buffer, in order (none crosses its text's end), and the ranks that sort them.

    `apart` numbers the texts' classes: suffixes of different ones have nothing in common, whatever their bytes.

    Prefix doubling from ranks of seven bytes up to half of `least` at most ranks all suffixes; longer
    prefixes are told apart a block of that length at a time, and only for suffixes that are long enough.
    """
    n = len(text)
    doc_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    here = np.arange(n)

    def ahead(values: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
        inside = at + by < doc_end[at]
        return np.where(inside, values[np.where(inside, at + by, 0)], 0)

    byte = text.astype(np.int64) + 1
    packed = byte.copy()
    for j in range(1, FIRST):
        packed = packed << 9 | ahead(byte, here, j)
    levels = [np.unique(packed, return_inverse=True)[1] + 1]
    if apart is not None:
        levels[0] = np.unique(np.repeat(apart, np.diff(np.concatenate([[0], ends]))) << 32 | levels[0], return_inverse=True)[1] + 1
    size = FIRST
    while size * 2 <= least:
        levels.append(np.unique(levels[-1] << 32 | ahead(levels[-1], here, size), return_inverse=True)[1] + 1)
        size *= 2
    long = np.flatnonzero(doc_end - here >= least)
    rank, upto = levels[-1][long], size
    longest = int((doc_end[long] - long).max()) if long.size else 0
    while upto < longest:
        rank = np.unique(rank << 32 | ahead(levels[-1], long, upto), return_inverse=True)[1]
        upto += size
    return long[np.argsort(rank, kind="stable")], levels


def common_prefixes(text: np.ndarray, order: np.ndarray, levels: list[np.ndarray], doc_end: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before (0 for the first), inside their texts."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(order), dtype=np.int64)
    room = np.minimum(doc_end[a] - a, doc_end[b] - b)
    got = np.zeros(len(a), dtype=np.int64)

    def grow(values: np.ndarray, size: int) -> bool:
        at = np.flatnonzero(got + size <= room)
        at = at[values[a[at] + got[at]] == values[b[at] + got[at]]]
        got[at] += size
        return bool(at.size)

    while grow(levels[-1], FIRST << (len(levels) - 1)):
        live = got < room
        if not live.any():
            break
    # a pair that fell behind the first block must not jump: lower levels only fill up to the next block
    for j in range(len(levels) - 2, -1, -1):
        grow(levels[j], FIRST << j)
    for _ in range(FIRST - 1):
        grow(text, 1)
    out[1:] = got
    return out


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, i, j): the nodes of the interval tree with common prefixes of `least` at least, suffixes i to j-1 in order; children before parents."""
    high = np.flatnonzero(lcp >= least)
    if not high.size:
        return
    for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
        lo, hi = int(run[0]) - 1, int(run[-1]) + 1
        stack: list[list[int]] = []
        for i in range(lo + 1, hi + 1):
            now, left = int(lcp[i]) if i < hi else 0, i - 1
            while stack and stack[-1][0] > now:
                length, left = stack.pop()
                yield length, left, i
            if now >= least and (not stack or stack[-1][0] < now):
                stack.append([now, left])


def maximal_repeats(texts: list[bytes], least: int, apart: list[int] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences): every string of `least` bytes or more that occurs twice in `texts` and can be extended neither way in all its occurrences; an occurrence is (text, start). `apart` numbers classes of texts, which are taken one by one."""
    ends = np.cumsum([len(t) for t in texts])
    if not len(ends) or not ends[-1]:
        return
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.concatenate([[0], ends[:-1]])
    order, levels = suffix_array(text, ends, least, None if apart is None else np.array(apart, dtype=np.int64))
    if len(order) < 2:
        return
    which = np.repeat(np.arange(len(texts)), ends - starts)
    lcp = common_prefixes(text, order, levels, ends[which])
    # the byte before each suffix; below zero and all different at the start of a text
    before = np.empty(len(text), dtype=np.int64)
    before[1:] = text[:-1]
    before[starts[ends > starts]] = -1 - np.arange(int((ends > starts).sum()))
    left = before[order]
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    for length, i, j in intervals(lcp, least):
        if changes[j - 1] > changes[i]:
            at = order[i:j]
            yield length, list(zip(which[at].tolist(), (at - starts[which[at]]).tolist(), strict=True))


# ---- picks of windows -----------------------------------------------------------


class _Picks:
    """Runs of windows [lo, hi] of a block that pick the k-gram at `at`; text by text, in order."""

    def __init__(self, b: K.Block, length: int, k: int):
        parts = [self._pick(b.data[b.offsets[i] : b.offsets[j]], b.offsets[i : j + 1] - b.offsets[i], length, k, int(b.offsets[i]), i) for i, j in B.cuts(b.offsets, B.SLICE)]
        self.at, self.lo, self.hi, self.doc, self.keys = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.length = length

    def contexts(self, data: np.ndarray) -> np.ndarray:
        """A number for each context, by its extent and its edges: different contexts of one k-gram differ in these but for chance."""
        code = B.codes(data)
        extent = (self.at - self.lo).astype(np.uint64) << np.uint64(32) | (self.hi - self.lo).astype(np.uint64)
        return B.join(B.join(extent, code[self.lo]), code[self.hi + self.length - 8])

    @staticmethod
    def _pick(data: np.ndarray, offsets: np.ndarray, length: int, k: int, base: int, doc0: int) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, np.int64)
        if len(data) < length:
            return none, none, none, none, np.zeros(0, np.uint64)
        grams = B.byte_windows(data, k)
        span, width = length - k + 1, 1
        least = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: -(span - width)], least[span - width :])
        starts = B.ranges(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
        if not starts.size:
            return none, none, none, none, np.zeros(0, np.uint64)
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return at[first] + base, starts[first] + base, starts[last] + base, doc[first] + doc0, B.mix(grams[at[first]])  # least hashes are small: mixed anew, they fill all buckets


_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("h1", "h2", "at", "doc_at", "ids")), ("texts", pa.binary())])


def pack_texts(texts: list[bytes]) -> bytes:
    return K.pack(pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"]))


def unpack_texts(packed: bytes) -> list[bytes]:
    return pa.ipc.open_stream(packed).read_next_batch().column(0).to_pylist()


#: Where a repeat stands: id, block, start of a context in it, start in the context.
Place = tuple[int, int, int, int]


def contexts_meet(rows: list[tuple], length: int, k: int, copied: Set[tuple[int, int]] = frozenset()) -> Iterator[tuple[int, bytes, list[Place]]]:
    """(length, string, occurrences) of the maximal repeats of contexts in rows (block, keys, starts, places of k-grams, ids, texts).

    A repeat holds its k-gram and, beside it, half of what surrounds it on the left or else on the right.  So the contexts of a k-gram are
    parted by what they hold there, those alone go, and each class comes into an array by itself.  A context of several places
    stands there once, and is a repeat by itself: a leaf of its tree with several occurrences.  So is one whose copies its block keeps to itself: `copied`, by block and start.
    """
    where: dict[int, dict[bytes, tuple[int, list[tuple[int, int, int]]]]] = {}
    for block, h1, at, gram, ids, texts in rows:
        for key, place, g, doc, text in zip(*(np.frombuffer(x, t).tolist() for x, t in ((h1, np.uint64), (at, np.uint32), (gram, np.uint32), (ids, np.int64))), unpack_texts(texts), strict=True):
            where.setdefault(key, {}).setdefault(text, (g - place, []))[1].append((doc, block, place))
    half = (length - k) // 2
    several = lambda places: len(places) > 1 or (places[0][1], places[0][2]) in copied
    texts: list[bytes] = []
    apart: list[int] = []
    owner: list[tuple[bool, int, list[tuple[int, int, int]]]] = []  # left side, offset of the k-gram, places of the context
    size = classes = 0

    def found() -> Iterator[tuple[int, bytes, list[Place]]]:
        whole = set()  # contexts that an interval has in full
        for n, at in maximal_repeats(texts, length, apart):
            t, start = at[0]
            left, g, _ = owner[t]
            if left == (start <= g - half):  # else the other side's class has it, with all its occurrences
                yield n, texts[t][start : start + n], [(*place, s) for t, s in at for place in owner[t][2]]
                whole.update(t for t, s in at if not s and n == len(texts[t]))
        for t, (left, g, places) in enumerate(owner):
            if t not in whole and left == (g >= half) and several(places):
                yield len(texts[t]), texts[t], [(*place, 0) for place in places]

    for group in where.values():
        if len(group) < 2 and not any(several(places) for _, places in group.values()):
            continue
        sides: dict[tuple[bool, bytes], list[bytes]] = {}
        for text, (g, _) in group.items():
            if g >= half:
                sides.setdefault((True, text[g - half : g + k]), []).append(text)
            if max(0, g - half + 1) + length <= len(text):
                sides.setdefault((False, text[g : g + k + half]), []).append(text)
        for (left, _), members in sides.items():
            g, places = group[members[0]]
            if len(members) < 2:
                if several(places) and left == (g >= half):
                    yield len(members[0]), members[0], [(*place, 0) for place in places]
                continue
            for text in members:
                g, places = group[text]
                texts.append(text)
                apart.append(classes)
                owner.append((left, g, places))
                size += len(text)
            classes += 1
            if size > ARRAY_BYTES:
                yield from found()
                texts, apart, owner, size = [], [], [], 0
    yield from found()


def removed(groups: Iterator[tuple[int, bytes, list[Place]]]) -> dict[int, list[int]]:
    """Runs (start, length, start, length, ...) for each block that all but the earliest occurrence of each repeat cover."""
    gone: dict[int, list[int]] = {}
    for n, _, places in groups:
        at = [(doc, block, place + s) for doc, block, place, s in places]
        first = min(at)
        for p in at:
            if p != first:
                gone.setdefault(p[1], []).extend((p[2], n))
    return gone


def _keyed(length: int, k: int):
    """Keys of a block's picks and numbers of their contexts, for K.repeated; the picks of a block are made once for both."""
    last: list = [None, None]

    def picks(b: K.Block) -> _Picks:
        if last[0] != b.block:
            last[:] = [b.block, _Picks(b, length, k)]
        return last[1]

    return (lambda b: picks(b).keys), (lambda b: picks(b).contexts(b.data))


def _sent(docs: DataFrame, scratch: Scratch, length: int, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame]:
    """The blocks of docs, and rows that bring what repeats together, dealt to their buckets.

    kind 2: different contexts of k-grams; 1: windows of hot k-grams; 0: what a block settles by itself, copies of its own contexts and windows.
    With `every`, contexts come with the starts of their texts, copies with the context that they copy, and windows with all their places.
    """
    if length < 48:
        raise ValueError("length must be 48 or more")
    k = GRAM
    rows = K.blocks(docs, scratch, text_col)
    n_bytes = rows.agg(F.sum("n_bytes")).first()[0] or 0
    n = K.bucket_count(n_bytes / 35, scratch)
    keys, contexts = _keyed(length, k)
    seen = K.repeated(rows, scratch, keys, n, id_col, text_col, contexts=contexts)
    n_meet = max(n, int(n_bytes / (8 << 20)) + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sent in K.each(batches, id_col, text_col):
            p = _Picks(b, length, k)
            if not p.at.size:
                continue
            again, hot = K.flagged(p.keys, n, sent)
            out: list[tuple] = []
            pairs = lambda x: np.array(x, dtype=np.uint32).tobytes()
            if hot.any():
                at = B.ranges(p.lo[hot], p.hi[hot] - p.lo[hot] + 1)
                doc = np.repeat(p.doc[hot], p.hi[hot] - p.lo[hot] + 1)
                more, later = K.window_rows(b, n_meet, 1, at, doc, b.offsets[:-1], *_hash_at(b.data, at, length), every)
                out += [(*r, None) for r in more]
                if later.size and not every:
                    out.append((0, b.block % n_meet, b.block, None, None, pairs(np.column_stack([later, np.full(len(later), length)])), None, None, None))
            cold = np.flatnonzero(again & ~hot)
            order = K.doc_order(b, p.doc[cold])
            cold = cold if order is None else cold[order]
            mine: dict[tuple[int, bytes], int] = {}
            gone: list[int] = []
            copies: list[tuple[int, int]] = []  # pick, pick of which it is a copy
            for i, key, lo, hi in zip(cold.tolist(), p.keys[cold].tolist(), p.lo[cold].tolist(), p.hi[cold].tolist(), strict=True):
                if (first := mine.setdefault((key, b.data[lo : hi + length].tobytes()), i)) != i:
                    gone += (lo, hi + length - lo)
                    copies.append((i, first))
            if gone:
                refer = [None, None, None]
                if every:
                    i, first = np.array(copies).T
                    refer = [pairs(b.offsets[p.doc[i]]), pairs(p.lo[first]), b.ids[p.doc[i]].tobytes()]
                out.append((0, b.block % n_meet, b.block, None, refer[0], pairs(gone), refer[1], refer[2], None))
            if mine:
                kept = np.fromiter(mine.values(), np.int64, len(mine))
                keys = p.keys[kept]
                order = np.argsort(keys, kind="stable")
                kept, keys, texts = kept[order], keys[order], [t for _, t in mine]
                for j, s in K.cuts_of(keys, n_meet):
                    begin = pairs(b.offsets[p.doc[kept[s]]]) + pairs(np.isin(kept[s], [first for _, first in copies])) if every else None
                    out.append((2, j, b.block, keys[s].tobytes(), begin, pairs(p.lo[kept[s]]), pairs(p.at[kept[s]]), b.ids[p.doc[kept[s]]].tobytes(), pack_texts([texts[o] for o in order[s].tolist()])))
            if out:
                yield K.batch_of(out, _SENT)

    sent = K.with_sent(rows, seen).mapInArrow(B.tidy(send), K.WINDOWS + ", texts binary")
    return rows, K.exchange(sent, n_meet)


_GROUPS = "kind int, block bigint, context bigint, at bigint, doc_id bigint, start bigint, length bigint, `group` string"


def repeat_groups(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each occurrence of each repeated string: group, length, doc_id, start (bytes in the row's text).

    The strings are the maximal repeats of `length` bytes or more inside contexts: of the windows that pick one
    place of a k-gram. A longer passage appears as a chain of them, one for each pick, with overlapping ends. Rows of one `group` are all
    occurrences of one string, in whatever row and place; two strings may overlap or hold one another.
    Windows of hot k-grams (more than K.HOT contexts) are listed one by one, each as a group of `length` bytes.

    Null texts count as empty; a null id is a null doc_id; rows that share an id are told apart by nothing here.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    _, sent = _sent(docs, scratch, length, id_col, text_col, every=True)

    def known(doc: int) -> int | None:
        return None if doc == K.NO_ID else doc

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in K.by_bucket(batches, ["block", "h1", "h2", "at", "doc_at", "ids", "kind", "texts"]):
            out: list[tuple] = []
            begins: dict[tuple[int, int], int] = {}
            copied: set[tuple[int, int]] = set()
            windows: dict[tuple[int, int], list[tuple]] = {}
            for block, h1, h2, at, doc_at, ids, kind, _ in rows:
                if kind == 0:
                    lo = np.frombuffer(at, np.uint32)[0::2].tolist()
                    out += [(0, block, first, None, known(doc), x - begin, None, None) for x, begin, first, doc in zip(lo, np.frombuffer(h2, np.uint32).tolist(), np.frombuffer(doc_at, np.uint32).tolist(), np.frombuffer(ids, np.int64).tolist(), strict=True)]
                elif kind == 1:
                    starts, places = np.frombuffer(doc_at, np.uint32), np.frombuffer(at, np.uint32)
                    which = np.searchsorted(starts, places, side="right") - 1
                    for a, b, x, begin, doc in zip(np.frombuffer(h1, np.uint64).tolist(), np.frombuffer(h2, np.uint32).tolist(), places.tolist(), starts[which].tolist(), np.frombuffer(ids, np.int64)[which].tolist(), strict=True):
                        windows.setdefault((a, b), []).append((1, block, None, None, known(doc), x - begin, length, f"w{a:016x}{b:08x}"))
                else:
                    begin, has = np.frombuffer(h2, np.uint32).reshape(2, -1).tolist()
                    for x, start, more in zip(np.frombuffer(at, np.uint32).tolist(), begin, has, strict=True):
                        begins[block, x] = start
                        if more:
                            copied.add((block, x))
            out += [w for same in windows.values() if len(same) > 1 for w in same]
            for n, string, places in contexts_meet([(r[0], r[1], r[3], r[4], r[5], r[7]) for r in rows if r[6] == 2], length, GRAM, copied):
                name = hashlib.blake2b(string, digest_size=16).hexdigest()
                out += [(1, block, place, s, known(doc), place + s - begins[block, place], n, name) for doc, block, place, s in places]
            kinds = (pa.int32(), *(pa.int64(),) * 6, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], x) for c, x in enumerate(kinds)], names=["kind", "block", "context", "at", "doc_id", "start", "length", "group"])

    made = scratch.table("groups", sent.mapInArrow(B.tidy(meet), _GROUPS))
    groups = made.where("kind = 1")
    copies = made.where("kind = 0").select("block", "context", F.col("doc_id").alias("copy"), F.col("start").alias("base"))
    more = groups.join(copies, ["block", "context"]).select("group", "length", F.col("copy").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"))
    return groups.select("group", "length", "doc_id", "start").unionByName(more)


def dedup_bytes(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input rows, all columns, with n_bytes, n_removed, n_spans, spans (start, length: maximal removed runs of bytes) and kept_sha256.

    Removes each byte covered by a `length`-byte string that also starts earlier: in a row with
    a smaller id, or earlier in the same row.  Strings are judged on the input and may
    overlap; matches never cross rows.  The text column becomes the kept bytes; bytes that
    are no UTF-8 any more (a cut may split a character) are replaced, kept_sha256 is over the bytes themselves.

    Null texts count as empty and stay null.  Rows with a null id come before all others;
    rows that share an id rank as they are stored.  Input columns named as one of
    those added are replaced.

    At scale: the same k-gram in more than K.HOT different contexts, summed up over blocks (a third of all rows may share one, or
    one may stand between ever other bytes), would gather them all in one task; windows of such hot picks go
    by the hash of the whole window instead, each block sending one of a kind.
    `length` is 48 at least: a shorter one leaves no room for k-grams.
    """
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
    docs = docs.drop(*added)
    scratch = Scratch(docs.sparkSession, "suffix")
    rows, sent = _sent(docs, scratch, length, id_col, text_col, every=False)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in K.by_bucket(batches, ["block", "h1", "h2", "at", "doc_at", "ids", "kind", "texts"]):
            out = [(r[0], r[3], 0) for r in rows if r[6] == 0]
            out += [(block, at, length) for block, at in K.later_windows([r[:6] for r in rows if r[6] == 1])]
            gone = removed(contexts_meet([(r[0], r[1], r[3], r[4], r[5], r[7]) for r in rows if r[6] == 2], length, GRAM))
            yield K.places_out([*out, *((block, np.array(x, dtype=np.uint32).tobytes(), 0) for block, x in gone.items())])

    gone = scratch.table("gone", sent.mapInArrow(B.tidy(meet), K.PLACES))
    scratch.drop("repeated")
    scratch.sweep()
    names = docs.columns
    t = names.index(text_col)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sent in K.each(batches, id_col, text_col):
            mark = np.zeros(len(b.data) + 1, dtype=np.int32)
            for r in sent:
                x = np.frombuffer(r["places"], np.uint32).astype(np.int64)
                lo, size = (x, r["size"]) if r["size"] else (x[0::2], x[1::2])
                np.add.at(mark, lo, 1)
                np.add.at(mark, lo + size, -1)
            off = np.cumsum(mark[:-1]) > 0
            kept_n = np.concatenate([[0], np.cumsum(~off)])[b.offsets]
            edge = off.copy()
            edge[1:] &= ~off[:-1]
            inner = b.offsets[:-1][np.diff(b.offsets) > 0]
            edge[inner] = off[inner]
            begin = np.flatnonzero(edge)
            stop = off.copy()
            stop[:-1] &= ~off[1:]
            final = b.offsets[1:][np.diff(b.offsets) > 0] - 1
            stop[final] = off[final]
            end = np.flatnonzero(stop) + 1
            span_at = np.searchsorted(begin, b.offsets)
            kept = b.data[~off]
            texts, digests = [], []
            null = b.text.is_null().to_pylist()
            for i in range(len(b)):
                raw = kept[kept_n[i] : kept_n[i + 1]].tobytes()
                digests.append(hashlib.sha256(raw).hexdigest())
                texts.append(None if null[i] else raw.decode(errors="replace"))
            n_all = np.diff(b.offsets)
            doc = np.searchsorted(b.offsets, begin, side="right") - 1
            spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - b.offsets[doc]), pa.array(end - begin)], names=["start", "length"]))
            cols = list(b.rows.columns)
            cols[t] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_all), pa.array(n_all - np.diff(kept_n)), pa.array(np.diff(span_at)), spans, pa.array(digests, pa.string())], names=[*names, *added])

    long = T.LongType()
    span = T.ArrayType(T.StructType([T.StructField("start", long), T.StructField("length", long)]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, x) for c, x in zip(added, (long, long, long, span, T.StringType()), strict=True))])
    gone = gone.groupBy("block").agg(F.collect_list(F.struct("places", "size")).alias("sent"))
    return K.with_sent(rows, gone).mapInArrow(B.tidy(cut_out), schema)


def _hash_at(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that start at the ascending places `at`, a slice of the text at a time."""
    h1, h2 = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    i = 0
    while i < len(at):
        j = max(int(np.searchsorted(at, at[i] + B.SLICE)), i + 1)
        part, rel = data[at[i] : at[j - 1] + length], at[i:j] - at[i]
        h1[i:j], h2[i:j] = B.byte_windows(part, length)[rel], B.byte_windows(part, length, salt=1)[rel]
        i = j
    return h1, h2


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs, length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP5_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, u.i AS i, md5_number(substr(h, 2 * u.i - 1, 200)) AS g FROM t, unnest(range(1, n - 98)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
e AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r),
s AS (SELECT doc_id, i, sum(CASE WHEN last IS NULL OR i > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
x AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY 1, 2),
y AS (SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM x),
z AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS upto, list({'a': before, 'n': a - before} ORDER BY a) AS kept FROM y GROUP BY 1)
SELECT t.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE array_to_string(list_transform(kept, lambda k: substr(h, 2 * k.a - 1, 2 * k.n)), '') || substr(h, 2 * upto - 1) END)) AS kept_sha256
FROM t LEFT JOIN z ON t.doc_id = z.doc_id
"""


def brute_force(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """What dedup_bytes gives for rows with distinct ids, by a dictionary of all windows."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        off = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                off[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(1 for i, x in enumerate(off) if x and not (i and off[i - 1]))
        out[doc_id] = (len(raw), sum(off), spans, hashlib.sha256(bytes(c for c, x in zip(raw, off, strict=True) if not x)).hexdigest())
    return out
