"""Helpers that work inside tasks: the memory they take for each byte, and the same results as the plain way."""

import tracemalloc

import numpy as np
import pyarrow as pa
from loomdex.llm import jaccard as J
from loomdex.llm import suffixes as S
from loomdex.llm import textkit as tk


def _peak(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_words_take_few_arrays_of_the_text():
    data, offsets = tk.string_buffer(pa.array(["some words here " * 70_000]))
    assert _peak(lambda: tk.Words(data, offsets)) < 24 * len(data)


def test_a_block_of_suffixes_takes_little_memory():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 123, 1 << 20, dtype=np.uint8)
    at = np.repeat(rng.integers(0, len(base) - 400, (S.BLOCK_BYTES // 700) + 1), 2)
    texts = [base[a : a + 350].tobytes() for a in at]
    n = np.full(len(texts), 350 - S.SHORT + 1)
    assert _peak(lambda: S.repeated(texts, n, np.full(len(texts), 50), np.arange(len(texts)) // 2, S.SHORT)) < 40 << 20


def test_words_over_a_stretch_have_the_hash_of_their_bytes():
    texts = ["x" * 65536, "y" * 65537 + " z", "z", "a b " * 40_000, None, "q" * 200_000]
    words = tk.Words(*tk.string_buffer(pa.array(texts)))
    for i, w in enumerate([w for t in texts if t for w in t.split()][:4] + ["a", "b"]):
        p = np.arange(len(w))
        vals = tk._BYTE[np.frombuffer(w.encode(), np.uint8)] * tk._POW[p & 0xFFFF] * tk._powers(tk._POW_HIGH, (len(w) >> 16) + 1)[p >> 16]
        assert words.hash[i] == tk.mix(np.array([vals.sum(dtype=np.uint64) + np.uint64(len(w))]))[0]


def test_counted_finds_frequent_shingles_only():
    h = np.sort(np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64))
    some = h[::7]
    heavy = (some, np.arange(1, len(some) + 1), J.marked(some))
    at, n = J.counted(h, heavy)
    assert np.array_equal(at, np.arange(0, 5000, 7)) and np.array_equal(n, heavy[1])
    none = np.zeros(0, np.uint64)
    assert len(J.counted(h, (none, none.astype(np.int64), J.marked(none)))[0]) == 0


def test_words_that_are_only_counted_take_less():
    data, offsets = tk.string_buffer(pa.array(["some words here " * 70_000]))
    assert _peak(lambda: tk.Words(data, offsets, lower=False, hashed=False)) < 8 * len(data)
