"""Hashes hold on texts that are built to make polynomial ones meet."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from evidentia.llm import _bytes as B
from evidentia.llm import minhash, packing, substring, suffix

SCHEMA = "doc_id bigint, text string"


def thue_morse(n):
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 8192, 1 << 19])
def test_alternating_words_differ(n):
    x, y = thue_morse(n)
    data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    starts, ends, _ = B.words(data, np.array([0, len(data)]))
    for salt in (0, 1):
        h = B.span_hashes(data, starts, ends, salt)
        assert h[0] == h[2] != h[1]
    assert B.span_hashes(data, starts, ends)[0] != B.span_hashes(data, starts, ends, 1)[0]


def test_windows_differ_exactly_where_texts_do():
    rng = random.Random(1)
    x, y = thue_morse(4096)
    for text in (x + y, "ab" * 900, "".join(rng.choice("ab") for _ in range(5000)), "a" * 500):
        data = np.frombuffer(text.encode(), np.uint8)
        words = B.mix(data.astype(np.uint64))
        for width in (8, 20, 32, 100, 1000):
            if width <= len(text):
                for h in (B.byte_windows(data, width), B.window_hashes(words, width), B.window_hashes(words, width, salt=1)):
                    assert len(h) == len(text) - width + 1
                    assert len(set(h.tolist())) == len({text[i : i + width] for i in range(len(h))})
                    assert len(set(zip(h.tolist(), (text[i : i + width] for i in range(len(h))), strict=True))) == len(set(h.tolist()))
    assert not len(B.byte_windows(np.zeros(5, np.uint8), 8)) and not len(B.window_hashes(np.zeros(0, np.uint64), 3))


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_operators_tell_alternating_words_apart(spark, n):
    x, y = thue_morse(n)
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(0, f"p q {x}"), (1, f"p q {y}"), (2, f"{x} {tail}"), (3, f"{y} {tail}"), (4, f"{x} {y}"), (5, f"{x}{y}{x}")]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, k=3, threshold=(85, 100)).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5}  # 2 and 3 share 17 of 19 shingles
    assert all(r["n_removed"] == 0 for r in substring.dedup_windows(df, window=20).collect())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_bytes(df, length=100).collect()}
    assert got == suffix.brute_force(rows, 100)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    for r in packing.pack(df, tokenizer=packing.default_tokenizer()).collect():
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_very_long_texts(spark, monkeypatch):
    """Beyond a slice, a chunk, a block and what a packer gathers, all in one text; one word beyond a slice."""
    from evidentia.llm import _blocks

    rng = random.Random(4)
    words = [f"w{rng.randrange(3000)}" for _ in range(150_000)]
    long = " ".join(words)
    rows = [(1, long), (2, "x" * (B.SLICE + 1000) + " " + " ".join(words[500:900])), (3, " ".join(words[:300])), (4, None)]
    monkeypatch.setattr(_blocks, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(packing, "GATHER", 10_000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_bytes(df, length=100).collect()}
    assert got == suffix.brute_force(rows, 100)
    seen, want = set(), {}
    for i, t in rows:
        w = (t or "").split()
        off = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                off[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = len(w), sum(off), hashlib.sha256(" ".join(x for x, o in zip(w, off, strict=True) if not o).encode()).hexdigest()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_windows(df, window=20).collect()} == want
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    pieces = packing.pack(df, tokenizer=packing.default_tokenizer()).collect()
    assert {i: sum(r["length"] for r in pieces if r["doc_id"] == i) for i in ids} == {i: len(x) for i, x in ids.items()}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, k=3).collect()}
    assert got[1][0] == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) and all(c == i for i, (_, c) in got.items())
