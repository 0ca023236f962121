"""Words of whole texts as numpy arrays: where they start, where they end, what they hash to.

Texts are looked at as UTF-8 bytes. Every character that separates words is
ASCII, so bytes and characters agree on where words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is worked on alone.
SLICE_BYTES = 1 << 20

SPACES = np.ones(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _odd_inverse(x: int) -> int:
    """The number that x, which is odd, must be multiplied with to give 1 modulo 2^64."""
    return pow(x, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ np.uint64((salt * 0xA0761D6478BD642F) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.bases = base, _odd_inverse(base)
        self.tables = [np.ones(1, dtype=np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            steps = [np.full(n, b, dtype=np.uint64) for b in self.bases]
            for s in steps:
                s[0] = 1
            self.tables = [np.cumprod(s, dtype=np.uint64) for s in steps]
        return self.tables


def _before(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums


class Slice:
    """Some texts and their words. starts and ends are byte positions, doc the row of each word,
    first[r]:first[r + 1] the words of row r."""

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.row, self.data, self.offsets = row, data, offsets
        is_word = inside[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1] | cut[1:-1]
        stops = is_word.copy()
        stops[:-1] &= ~is_word[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, powers: Powers) -> np.ndarray:
        """64 bits for every word."""
        table = mix(np.arange(1, 257, dtype=np.uint64))
        up, down = powers.upto(len(self.data) + 1)
        sums = _before(table[self.data] * up[: len(self.data)])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def byte_powers() -> Powers:
    return Powers(_BYTE_BASE)


def word_powers(other: bool = False) -> Powers:
    """other: a second base, for hashes that are independent of the first."""
    return Powers(_BYTE_BASE ^ 0x5555555555555554 if other else _WORD_BASE)


def gram_hashes(hashes: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """64 bits for each run of k words, by its first word. Runs that leave a text are among them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.upto(len(hashes) + 1)
    sums = _before(hashes * up[: len(hashes)])
    return mix((sums[k:] - sums[:-k]) * down[:n], k)


def slices(texts: pa.Array, inside: np.ndarray, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts into slices of at most limit bytes, or of one text. Null is the empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        part = data[offsets[row] : offsets[end]]
        yield Slice(row, LOWER[part] if lower else part, offsets[row : end + 1] - offsets[row], inside)
        row = end
