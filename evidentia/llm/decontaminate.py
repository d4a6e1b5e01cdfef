"""Benchmark passages in documents, also edited ones: random walks, bit-sampling hashes, exact edit distance.

A walk (CGK) reads a text and at each step writes the byte it stands on, then stays or goes on by a coin that depends
on the step and the byte alone.  Two texts that differ by few edits, walked with the same coins, soon write the same
again: edit distance becomes Hamming distance, and a hash of a few sampled steps finds near ones.

At 15 % edits a walk over a whole item falls out of step (of its outputs a third agree, measured), so a window
of an item's size is walked anew from each of its words and sampled from the first steps: one word
after which the walks agree long enough speaks for the window.  Each candidate's block of 32 bytes is then compared
bit-parallel, and what is left verified by exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as K
from . import _bytes as B

#: Bytes of item texts whose tables a worker holds at one time, and of those that go out in one pass over the documents.
ITEM_BYTES, PASS_BYTES = 2 << 20, 256 << 20
#: Bytes of documents worked on at one time, and held where items are of several tables.
CHUNK, HOLD = 1 << 19, 16 << 20
#: Windows walked in step.
STEP = 1 << 14
#: Candidates that are looked at in step, and bytes of each (64 at most).
BLOCK, NEAR = 1 << 13, 32
#: Walks, and samples of each. With LEVELS they find over 0.99 of random edits at 15 % (measured by length, see the tests).
WALKS, SAMPLES = 3, 2
#: For items up to so many bytes: steps that are walked, and steps that are sampled of these.
LEVELS = [(96, 24, 8), (1 << 62, 40, 12)]
#: Windows of items from which on a sample has one more step for each GROWTH times as many, and one more walk: candidates stay few.
FEW, GROWTH = 50_000, 6
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)

_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 0x20
_FOLD[0x41:0x5B] += 0x20


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with A-Z lowered and each run of ASCII bytes that are no letters or digits as one space: bytes, offsets, and the place of each byte in the input."""
    x = _FOLD[data]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
    keep[offsets[:-1][offsets[:-1] < len(x)]] = True
    at = np.flatnonzero(keep)
    return x[at], np.searchsorted(at, offsets), at


def edit_search(masks: dict[int, int], m: int, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """(least distance, end): the pattern against substrings of text that end there, or against prefixes if anchored; bit-parallel, exact."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        now += bool(ph & high) - bool(mh & high)
        ph = ph << 1 & full | anchored
        mh = mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if now < best:
            best, end = now, j
    return best, end


def _masks(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where windows begin: words, each character of three bytes or more, what follows one or a symbol of two bytes, and places inside long words that their bytes choose."""
    n = len(data)
    padded = np.zeros(n + 4, dtype=np.uint8)
    padded[4:] = data
    space, wide = padded == 0x20, padded >= 0xE0
    begins = space[3:-1] | wide[4:] | wide[1:-3] | (padded[:-4] >= 0xF0) | (padded[2:-2] == 0xC2)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    begins &= (data != 0x20) & ((data & 0xC0) != 0x80)
    at = np.flatnonzero(begins)
    far = np.flatnonzero(np.diff(np.append(at, n)) > 24)
    if far.size:
        inner = B.ranges(at[far] + 8, np.append(at, n)[far + 1] - at[far] - 8)
        three = data[inner].astype(np.uint32) * 31 + data[inner - 1] * np.uint32(17) + data[inner - 2]
        inner = inner[((three * np.uint32(0x9E3779B1)) >> np.uint32(29) == 0) & (data[inner] != 0x20)]
        at = np.sort(np.concatenate([at, inner]))
    return at


class Walks:
    """Coins and sampled steps, the same on every worker."""

    def __init__(self, walks: int, levels: list[tuple[int, int]], seed: int = 20240301):
        rng = np.random.default_rng(seed)
        self.levels, self.steps = levels, max((steps for steps, _ in levels), default=0)
        # the coin of a step: the top bit of a random linear function of the byte
        self.slope = rng.integers(0, 128, (walks, self.steps), dtype=np.uint8) * np.uint8(2) + np.uint8(1)
        self.shift = rng.integers(0, 256, (walks, self.steps), dtype=np.uint8)
        # for each walk and step: the levels and samples that look at it, and as which of their bytes
        self.look: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(self.steps)] for _ in range(walks)]
        self.width = -(-max((sampled for _, sampled in levels), default=0) // 8) * 8
        for w in range(walks):
            for level, (steps, sampled) in enumerate(levels):
                for s in range(SAMPLES):
                    for k, j in enumerate(rng.choice(steps, min(sampled, steps), replace=False).tolist()):
                        self.look[w][j].append((level, s, k))

    def __call__(self, padded: np.ndarray, at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (level, sample, window) of walk w from places `at`, and for each level where it ends. `padded` has `steps` bytes behind the text."""
        keys = np.empty((len(self.levels), SAMPLES, len(at)), dtype=np.uint64)
        ends = np.empty((len(self.levels), len(at)), dtype=np.int64)
        seen = np.zeros((len(self.levels), SAMPLES, STEP, self.width), dtype=np.uint8)
        slope, shift = self.slope[w].tolist(), self.shift[w].tolist()
        for k in range(0, len(at), STEP):
            here = at[k : k + STEP].astype(np.intp)
            c = np.empty(len(here), dtype=np.uint8)
            for j in range(self.steps):
                padded.take(here, out=c, mode="clip")
                for level, s, i in self.look[w][j]:
                    seen[level, s, : len(here), i] = c
                c *= slope[j]
                c += shift[j]
                c >>= 7
                here += c
                for level, (steps, _) in enumerate(self.levels):
                    if j + 1 == steps:
                        ends[level, k : k + STEP] = here
            eights = seen.view("<u8")[:, :, : len(here)]
            h = eights[..., 0] * B._MULT
            for i in range(1, self.width // 8):
                h = (h ^ (h >> np.uint64(32)) ^ eights[..., i]) * B._MULT
            keys[:, :, k : k + STEP] = h ^ (h >> np.uint64(29))
        return keys, ends


class _Table:
    """Sorted keys with what they stand for, behind a map of bits that turns most others away."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.columns = keys[order], [c[order] for c in columns]
        bits = min(max(int(len(keys) * 32).bit_length(), 16), 26)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[((keys * B._MULT) >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Indices of keys that are in the table, once for each entry, and the entries' columns."""
        p = np.flatnonzero(self.maybe[((keys * B._MULT) >> self.shift).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, keys[p], "left"), np.searchsorted(self.keys, keys[p], "right")
        j = B.ranges(lo, hi - lo)
        return np.repeat(p, hi - lo), [c[j] for c in self.columns]


def _words(text: bytes) -> int:
    """Words; in scripts without spaces two characters (of three bytes or more each) count as one."""
    return max(len(text.split()), sum(c >= 0xE0 for c in text) // 2)


class _Items:
    """Folded items, and tables of their windows' sampled walks. Short ones are found by their first eight bytes (too)."""

    def __init__(self, rows: list[tuple[int, str]], ratio: float, least_words: int):
        data, offsets, _ = fold(*B.flat(pa.array([t for _, t in rows], pa.string())))
        texts = [data[a:b].tobytes().strip() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        chosen = [i for i, t in enumerate(texts) if t]
        self.ids, self.texts = [rows[i][0] for i in chosen], [texts[i] for i in chosen]
        self.short = np.array([_words(t) < least_words for t in self.texts], dtype=bool)
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.most = np.minimum(np.where(self.short, 0, self.size * ratio).astype(np.int64), np.maximum(self.size - 1, 0))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        at = word_starts(self.data, self.begin)
        item = np.searchsorted(self.begin, at, side="right") - 1
        at, item = at[~self.short[item]], item[~self.short[item]]
        more = max(0, math.ceil(math.log(max(len(at), 1) / FEW, GROWTH)))
        which = np.searchsorted([most for most, _, _ in LEVELS], self.size[item], "left")
        used = np.unique(which).tolist()
        self.walks = Walks(WALKS + more, [(LEVELS[u][1], LEVELS[u][2] + more) for u in used])
        self.tables: list[list[tuple[int, int, _Table]]] = []  # for each walk: level, sample, table
        padded = np.concatenate([self.data, np.zeros(self.walks.steps + 1, np.uint8)])
        for w in range(WALKS + more if len(at) else 0):
            keys, ends = self.walks(padded, at, w)
            made = []
            for level, u in enumerate(used):
                # a walk that leaves the item reads what no document need hold
                inside = np.flatnonzero((which == u) & (ends[level] <= self.begin[item + 1]))
                for s in range(SAMPLES):
                    made.append((level, s, _Table(keys[level, s, inside], item[inside], at[inside] - self.begin[item[inside]])))
            self.tables.append(made)
        code = B.codes(self.data)
        self.exact = []
        shorts = np.flatnonzero(self.short | (self.size < 32))  # of the longer ones each walk from the first word stays inside
        for width in np.unique(np.minimum(self.size[shorts], 8)).tolist():
            t = shorts[np.minimum(self.size[shorts], 8) == width]
            self.exact.append((width, _Table(code[self.begin[t]] & B._MASK[width], t)))


def _near(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, kind: np.ndarray, pattern: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether patterns (of up to NEAR bytes, one for each kind) stand about `at`, inside [lo, hi), with at most `most` edits: bit-parallel over all candidates."""
    masks, row = np.zeros(len(pattern) << 8, dtype=np.uint64), np.arange(len(pattern)) << 8
    for j in range(NEAR):
        masks[row + pattern[:, j]] |= _BIT[j]
    masks[row] = 0  # no text holds the byte zero
    row, e, m = kind.astype(np.int64) << 8, most[kind], size[kind]
    first, last = np.maximum(at - e, lo), np.minimum(at + m + e, hi)
    high, one = _BIT[m - 1], np.uint64(1)
    pv, mv = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), dtype=np.uint64)
    now = m.astype(np.int16)
    best = now.copy()
    for j in range(int((last - first).max(initial=0))):
        place = first + j
        c = np.where(place < last, data[np.minimum(place, len(data) - 1)], 0)
        eq = masks[row + c]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        now += (ph & high) != 0
        now -= (mh & high) != 0
        ph <<= one
        mh <<= one
        pv, mv = mh | ~(xv | ph), ph & xv
        np.minimum(best, now, out=best)
    return best <= e


def _apart(left: str, right: str) -> bool:
    """Whether a word may end between two characters: not between letters or digits of scripts that write spaces."""
    return not (left.isalnum() and right.isalnum() and ord(left) < 0x0E00 and ord(right) < 0x0E00)


def candidates(items: _Items, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, items and starts of the item-sized windows that samples of a walk speak for, and that agree on a block of bytes there."""
    at = word_starts(data, offsets)
    padded = np.concatenate([data, np.zeros(items.walks.steps + 9, np.uint8)])
    found = []  # place, item, offset in the item
    for w, tables in enumerate(items.tables):
        keys, _ = items.walks(padded, at, w)
        for level, s, table in tables:
            p, (item, offset) = table.find(keys[level, s])
            found.append((at[p], item, offset))
    code = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for width, table in items.exact:
        p, (item,) = table.find(code[at] & B._MASK[width])
        found.append((at[p], item, np.zeros(len(p), np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, item, offset = (np.concatenate(c) for c in zip(*found, strict=True))
    doc = np.searchsorted(offsets, place, side="right") - 1
    start = place - offset
    # several samples may name one place
    order = np.lexsort((offset, start, item, doc))
    item, offset, doc, start = item[order], offset[order], doc[order], start[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (offset[1:] != offset[:-1])
    item, offset, doc, start = item[new], offset[new], doc[new], start[new]
    keep = items.short[item].copy()  # of these the last step looks at each byte
    size = np.minimum(items.size[item], NEAR)
    offset = np.minimum(offset, items.size[item] - size)
    for k in range(0, len(doc), BLOCK):
        todo = np.flatnonzero(~keep[k : k + BLOCK]) + k
        if not len(todo):
            continue
        kinds, first, kind = np.unique(items.begin[item[todo]] + offset[todo], return_index=True, return_inverse=True)
        n = size[todo][first]
        pattern = np.zeros((len(kinds), NEAR), dtype=np.uint8)
        filled = np.arange(NEAR) < n[:, None]
        pattern[filled] = items.data[B.ranges(kinds, n)]
        # the block may hold more than its share of the edits: twice the item's rate, and all of a short item's
        most = np.minimum(items.most[item[todo][first]], np.ceil(2 * n * items.most[item[todo][first]] / items.size[item[todo][first]]).astype(np.int64) + 1)
        keep[todo] = _near(data, offsets[doc[todo]], offsets[doc[todo] + 1], start[todo] + offset[todo], kind, pattern, n, most)
    return doc[keep], item[keep], start[keep]


def _runs(items: _Items, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, least and greatest start of each run of close starts, at most twice the item's distance wide."""
    if not len(doc):
        return iter(())
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > items.most[item[1:]])
    run = np.cumsum(new) - 1
    part = (start - start[new][run]) // (2 * items.most[item] + 1)
    new[1:] |= part[1:] != part[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(doc)) - 1
    return zip(doc[at].tolist(), item[at].tolist(), start[at].tolist(), start[end].tolist(), strict=True)


class _Search:
    """Places of items in texts, verified exactly."""

    def __init__(self, items: _Items):
        self.items, self.masks = items, {}

    def _exact(self, data: np.ndarray, lo: int, hi: int, a: int, t: int) -> bool:
        """Whether the item is there byte for byte; a short one must not lie inside a longer word."""
        text = self.items.texts[t]
        b = a + len(text)
        if a < lo or b > hi or data[a:b].tobytes() != text:
            return False
        if not self.items.short[t]:
            return True
        shown = text.decode()
        before, after = data[max(lo, a - 4) : a].tobytes().decode(errors="ignore"), data[b : min(hi, b + 4)].tobytes().decode(errors="ignore")
        return (not before or _apart(before[-1], shown[0])) and (not after or _apart(shown[-1], after[0]))

    def __call__(self, raw: np.ndarray, raw_at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item, start and length in bytes, distance."""
        items = self.items
        data, offsets, back = fold(raw, raw_at)
        seen = set()
        for d, t, a, last in _runs(items, *candidates(items, data, offsets)):
            text, slack = items.texts[t], int(items.most[t])
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            if not slack:
                if not self._exact(data, lo, hi, a, t):
                    continue
                begin, end, dist = a, a + len(text), 0
            else:
                if t not in self.masks:
                    self.masks[t] = (_masks(text), _masks(text[::-1]))
                lo = max(lo, a - slack)
                part = data[lo : min(hi, last + len(text) + slack)].tobytes()
                dist, end = edit_search(self.masks[t][0], len(text), part)
                if dist > slack:
                    continue
                _, length = edit_search(self.masks[t][1], len(text), part[:end][::-1], anchored=True)
                begin, end = lo + end - length, lo + end
            place = d, t, int(back[begin]) - int(raw_at[d]), int(back[end - 1]) + 1 - int(back[begin]), dist
            if place not in seen:  # runs that overlap may lead to one place
                seen.add(place)
                yield place


def _searches(parts: list[bytes], ratio: float, least_words: int) -> Iterator[_Search]:
    for p in parts:
        rows = pa.ipc.open_stream(p).read_next_batch()
        known = _Items(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), ratio, least_words)
        if known.texts:
            yield _Search(known)


def _held(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about `most` bytes of text; 0: one by one."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(B.flat(batch.column(text))[1][-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(shared, text: int, ratio: float, least_words: int):
    """Goes over batches once and gives each with its places: (row, item id, start, length, distance)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        parts = shared.value
        alone = list(_searches(parts, ratio, least_words)) if len(parts) < 2 else None  # of several tables one is held at a time
        for held in _held(batches, text, HOLD if alone is None else 0):
            out: list[list[tuple]] = [[] for _ in held]
            for search in alone if alone is not None else _searches(parts, ratio, least_words):
                for n, batch in enumerate(held):
                    raw, raw_at = B.flat(batch.column(text))
                    for i, j in B.cuts(raw_at, CHUNK):
                        out[n] += [(i + d, search.items.ids[t], *rest) for d, t, *rest in search(raw[raw_at[i] : raw_at[j]], raw_at[i : j + 1] - raw_at[i])]
            yield from zip(held, out, strict=True)

    return scan


def _passes(items: DataFrame, item_id_col: str, item_text_col: str) -> Iterator:
    """Broadcasts of packed items, PASS_BYTES at most each: one, unless the items are more."""
    spark = items.sparkSession
    rows = items.where(F.col(item_id_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("bigint").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    tables = int(total / ITEM_BYTES) + 1
    per_pass = PASS_BYTES // ITEM_BYTES
    rows = rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(tables)))
    for first in range(0, tables, per_pass):
        got = rows.where(F.col("part").between(first, first + per_pass - 1)).toArrow().sort_by([("part", "ascending"), ("i", "ascending"), ("t", "ascending")]).combine_chunks()
        parts = [K.pack(pa.RecordBatch.from_arrays([p.column(0).combine_chunks(), p.column(1).combine_chunks()], names=["i", "t"])) for k in range(first, min(first + per_pass, tables)) if len(p := got.filter(pa.compute.equal(got.column("part"), k)))]
        yield spark.sparkContext.broadcast(parts)


def contaminated(docs: DataFrame, items: DataFrame, *, ratio: float = 0.15, least_words: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each place where a row of docs holds an item: doc_id, item_id, start, length (bytes of the text), distance.

    Compared are texts with A-Z lowered and each run of ASCII punctuation and white space as one space;
    a place counts if its edit distance in bytes is at most `ratio` of the item's length. Unedited copies are always found, edited ones with
    a recall of 0.95 at least, up to the ratio (of places that overlap almost wholly, the one with the least distance).
    Items of fewer than `least_words` words count where they stand unedited and not inside a longer word; in scripts without
    spaces two characters count as a word, and any place as a word's end.
    Items without a letter or digit, null ones and those with a null id are passed over; null and empty documents hold none.
    Rows with a null id are reported with a null doc_id, repeated rows each for itself; other columns are ignored.

    Documents are read once for each PASS_BYTES of items, which go to the workers as one broadcast of that bound;
    a worker holds the tables of ITEM_BYTES of them at a time.
    """
    schema = "doc_id bigint, item_id bigint, start bigint, length bigint, distance bigint"
    pairs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _passes(items, item_id_col, item_text_col):
        scan = _scan(shared, 1, ratio, least_words)

        def places(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for batch, found in scan(batches):
                found.sort()
                rows = pa.array([r[0] for r in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array([r[c] for r in found], pa.int64()) for c in range(1, 5))], names=["doc_id", "item_id", "start", "length", "distance"])

        found = pairs.mapInArrow(B.tidy(places), schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, *, ratio: float = 0.15, least_words: int = 8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which `contaminated` finds no place. Each row is judged by itself, whatever its id: none needed."""
    at = docs.columns.index(text_col)
    for shared in _passes(items, item_id_col, item_text_col):
        scan = _scan(shared, at, ratio, least_words)

        def clean(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for batch, found in scan(batches):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r[0] for r in found]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(B.tidy(clean), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
