"""Token sequences of fixed capacity by harmonic packing.

A piece of length n belongs to class k = capacity // n: k of its class fill a
bin whatever their exact lengths.  A text beyond the capacity gives whole sequences first, and
its tail goes to the class of its own length.  Each worker keeps its bins alone; no two workers need to
agree on anything.  The room that a full count leaves over is filled with cuts from texts of the
first class (of more than half the capacity), so almost no padding remains.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B

#: Id that ends each document.
END = 1
#: Tokens that a worker gathers before it closes bins.
GATHER = 500_000
#: Words whose ids a worker remembers.
REMEMBER = 300_000
#: Bytes of text worked on at one time.
CHUNK = 1 << 20

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True


class Words:
    """Ids of whole texts, by words: the tokenizer lowers case and splits at white space, and between letters and punctuation, before it merges, so a text's ids are those of its pieces in a row."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = self.check = np.zeros(0, dtype=np.uint64)  # two independent hashes, in order of the first
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has. Words of letters alone go together, for they end in ids that end a word."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        made: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        groups = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        single = sorted(set(range(len(words))) - set(plain))
        for group, x in zip(groups, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):  # letters to one side, not to the other
                single += group
                continue
            for i, a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                made[i] = ids[a:b]
        for i, x in zip(single, self.tokenizer.encode_batch_fast([words[i] for i in single], add_special_tokens=False), strict=True):
            made[i] = np.array(x.ids, dtype=np.uint32)
        return np.concatenate([*made, np.zeros(0, np.uint32)]), np.array([len(x) for x in made], dtype=np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text's begin."""
        if not (data == ord("<")).any():  # names of special tokens mind case
            data = B.lower_ascii(data)
        s, e, _ = B.words(data, offsets)
        cut = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1
        cut = cut[~np.isin(cut, offsets)]  # not where a text starts
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
        first = np.searchsorted(s, offsets)
        hashes, check = B.span_hashes(data, s, e), B.span_hashes(data, s, e, salt=1)
        order = np.argsort(hashes)
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        if (check[order[1:]] != check[order[:-1]])[~new[1:]].any():  # words that share one hash only
            order = np.lexsort((check, hashes))
            new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
        one = order[new]
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        if len(self.keys) > REMEMBER:
            self.clear()
        pos = self._find(hashes[one], check[one])
        fresh = one[pos < 0]
        if fresh.size:
            ids, size = self._encode([data[a:b].tobytes().decode() for a, b in zip(s[fresh].tolist(), e[fresh].tolist(), strict=True)])
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids])
            into = np.searchsorted(self.keys, hashes[fresh])
            self.keys, self.check, self.at, self.size = (np.insert(old, into, x) for old, x in ((self.keys, hashes[fresh]), (self.check, check[fresh]), (self.at, at), (self.size, size)))
            pos = self._find(hashes[one], check[one])
        at, size = self.at[pos][which], self.size[pos][which]
        return self.ids[B.ranges(at, size)], np.concatenate([[0], np.cumsum(size)])[first]

    def _find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of words among those remembered, by both hashes; -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        pos = np.searchsorted(self.keys, keys)
        open_, out = np.arange(len(keys)), np.full(len(keys), -1)
        while open_.size:  # once, but for words that share one hash only
            at = pos[open_]
            same = at < len(self.keys)
            open_, at = open_[same], at[same]
            same = self.keys[at] == keys[open_]
            open_, at = open_[same], at[same]
            hit = self.check[at] == check[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit]
            pos[open_] += 1
        return out


class Packer:
    """Bins of one worker. Takes texts as ids in a row and gives columns of pieces (doc, start, length, crc, doc_tokens, bin, offset)."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self._empty()

    def _empty(self) -> None:
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.size: list[int] = []
        self.held = 0

    def take(self, docs: list[int | None], ids: np.ndarray, at: np.ndarray) -> None:
        """Texts docs[i] with ids[at[i]:at[i+1]]."""
        self.docs += docs
        self.ids.append(ids)
        self.size += np.diff(at).tolist()
        self.held += len(ids)

    def close(self) -> list[list]:
        """Packs all that is held. A text that fits a sequence is one piece, unless it is cut for filling."""
        capacity, docs, size = self.capacity, self.docs, self.size
        flat = np.concatenate([*self.ids, np.zeros(0, np.uint32)]).astype("<u4", copy=False)
        begin = np.cumsum([0, *size])
        done = [0] * len(docs)
        out: list[list] = [[] for _ in range(7)]

        def piece(t: int, n: int, offset: int) -> int:
            a = int(begin[t]) + done[t]
            for column, x in zip(out, (docs[t], done[t], n, zlib.crc32(flat[a : a + n]), size[t], self.next, offset), strict=True):
                column.append(x)
            done[t] += n
            return offset + n

        for t, n in enumerate(size):  # whole sequences of long texts; what is left of them has a class like others
            while n - done[t] >= capacity:
                piece(t, capacity, 0)
                self.next += 1
        left = lambda t: size[t] - done[t]
        rest = sorted((t for t in range(len(docs)) if left(t)), key=left)
        halves = next((i for i, t in enumerate(rest) if left(t) * 2 > capacity), len(rest))
        # the shortest first, so that the first class is there to fill the room of all others
        small, first = deque(rest[:halves]), deque(rest[halves:])
        cut: list[int] = []  # the text that is being cut
        while small or first or cut:
            source, offset = small or first, 0
            k = capacity // left(source[0]) if source else 0
            for _ in range(k):
                if not source or capacity // left(source[0]) != k:
                    break
                offset = piece(source[0], left(source[0]), offset)
                source.popleft()
            while offset < capacity and (cut or first or small):
                t = cut.pop() if cut else (first or small).pop()
                offset = piece(t, min(left(t), capacity - offset), offset)
                if left(t):
                    cut.append(t)
            self.next += 1
        self._empty()
        return out


def pack(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's for the whole text, no special ones added, then END; a null or
    empty text has END alone.  Pieces of a sequence lie without gaps from 0 and never exceed the capacity; pad a shorter
    sequence to it, if its length is no power of two.  Rows with a null id and repeated rows are
    packed like others.  Other columns are ignored.

    `tokenizer` is the path of a `tokenizers` file on every worker; it must lower case, and split at ASCII white space and between letters and punctuation, before merging.
    sequence_id holds the worker's partition in its upper bits, so workers agree without talking and a task that is run
    again gives the same ids.  A worker holds GATHER tokens, or one longer document.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = Words(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in packer.close()], names=names)

        for batch in batches:
            data, offsets = B.flat(batch.column(1))
            for i, j in B.cuts(offsets, CHUNK):
                ids, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ended = np.insert(ids, at[1:], np.uint32(END))
                packer.take(batch.column(0).slice(i, j - i).to_pylist(), ended, at + np.arange(len(at)))
                if packer.held > GATHER:
                    yield made()
        yield made()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(B.tidy(work), PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=default_tokenizer(), capacity=2048)
