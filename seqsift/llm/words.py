"""Words of whole batches of texts, found and hashed without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that end a word: white space only, or all ASCII but digits and letters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Words are polynomials of their bytes, modulo 2**64 and modulo a prime: where words collide in one, as strings made for it can in the first, they differ in the other.
_BASE = 0x9E3779B97F4A7C15
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_486_310_507


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_mod(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
    return out[:n]


class _Powers:
    """Powers up to the longest data seen; they aren't sent along with functions, as each worker soon has its own."""

    def __init__(self):
        self.n, self.tables = 0, None

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self.n >= n:
            return self.tables
        size = max(n, 1 << 18)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down), _powers_mod(_PRIME_BASE, size), _powers_mod(pow(_PRIME_BASE, -1, _PRIME), size)
        if size <= 1 << 22:  # a very long text's tables go with it
            self.n, self.tables = size, tables
        return tables


_powers = _Powers()


class RunHashes:
    """64-bit hashes of any runs of bytes in ``data``, A-Z lower-cased."""

    def __init__(self, data: np.ndarray):
        self.up, self.down, self.prime_up, self.prime_down = _powers.upto(len(data) + 1)
        low = _LOWER[data].astype(np.uint64) + np.uint64(1)
        self.sums, self.prime_sums = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
        np.cumsum(low * self.up[: len(data)], out=self.sums[1:])
        low *= self.prime_up[: len(data)]
        np.cumsum((low & np.uint64(_PRIME)) + (low >> np.uint64(31)), out=self.prime_sums[1:])  # below 2**32 each

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        first = (self.sums[stop] - self.sums[start]) * self.down[start]
        second = (self.prime_sums[stop] - self.prime_sums[start]) % np.uint64(_PRIME) * self.prime_down[start] % np.uint64(_PRIME)
        return mix(mix(first) + second * np.uint64(0xD6E8FEB86659FD93))


def text_slices(column: pa.Array, limit: int = 1 << 17):
    """Runs of texts with about ``limit`` bytes each, or one longer text: (first, last + 1, bytes, offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where the words of each text begin. No word spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~ends[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    stop = np.flatnonzero(inside & ~after[1:]) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z lower-cased, and where the words of each text begin."""
    start, stop, of_text = word_spans(data, offsets, ends)
    return RunHashes(data)(start, stop), of_text


def word_numbers(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, int]:
    """A number for each word, the same for the same bytes with A-Z lower-cased and for no others; where the words of each text begin; how many numbers there are."""
    start, stop, of_text = word_spans(data, offsets, ends)
    places = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=places[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(_LOWER[data][~ends[data]]))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of_text, len(coded.dictionary)


def exact_shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted numbers of its distinct k-word shingles, equal for equal words only, whatever hashes do. A text of fewer words has none.

    Numbers hold among the texts of one call.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    out: list[np.ndarray] = []
    for _, _, data, offsets in text_slices(texts, 1 << 62):
        words, of, n = word_numbers(data, offsets)
        m = max(0, len(words) - k + 1)
        code, bound = words[:m].astype(np.uint64), max(1, n)
        for i in range(1, k):
            if bound * n >= 1 << 63:
                known, code = np.unique(code, return_inverse=True)
                code, bound = code.astype(np.uint64), len(known)
            code = code * np.uint64(max(1, n)) + words[i : m + i].astype(np.uint64)
            bound *= max(1, n)
        out += [np.unique(code[of[d] : max(of[d], min(m, of[d + 1] - k + 1))]) for d in range(len(offsets) - 1)]
    return out


def hashes_of(text: str, ends: np.ndarray = SPACES) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), ends)[0]


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x100000001B3) + words[i : i + n])
    return out
