"""Words, word hashes and hashes of word sequences of Arrow text columns, with numpy.

Texts of a batch are handled as one byte buffer in slices of bounded size, so the
cost per document is small and memory follows the slice (or one long document).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _inverse(odd: np.uint64) -> np.uint64:
    return U(pow(int(odd), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; grows as needed, kept up to 4 M entries."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have[:n]


def rolling(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums whose differences, scaled back, are polynomial hashes of any span."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, base: np.uint64) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * powers(_inverse(base), len(prefix))[start])


@lru_cache(2)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F) + U(seed))


def byte_class(matches) -> np.ndarray:
    return np.array([bool(matches(b)) for b in range(256)])


# Bytes that end a word.  UTF-8 continuation bytes are all above 0x7F, so classes
# of ASCII characters can be told byte by byte.
SPACES = byte_class(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
NOT_ALNUM = byte_class(lambda b: b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of some documents: byte spans in ``data`` and first word of each document."""

    row: int
    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray  # len(documents) + 1

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 7) -> np.ndarray:
        prefix = rolling(_byte_values(seed)[self.data], _BASE)
        return spans(prefix, self.start, self.stop, _BASE)

    def texts(self, a: int, b: int) -> list[bytes]:
        raw = self.data
        return [raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.stop[a:b], strict=True)]


def sequence_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; positions near the end are left out."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    prefix = rolling(word_hash, _STEP)
    start = np.arange(n)
    return spans(prefix, start, start + k, _STEP)


def inside(words: Words, k: int) -> np.ndarray:
    """Which of the sequences of k words lie in one document."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    last = np.repeat(words.first[1:], words.counts())
    return np.arange(n) + k <= last[:n]


def slices(texts: pa.Array, separators: np.ndarray, lower: bool,
           limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of the texts (null counts as empty), some documents at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        data = raw[offsets[a] : offsets[b]]
        if lower:
            data = LOWER[data]
        yield _words(a, data, offsets[a : b + 1] - offsets[a], separators)
        a = b


def _words(row: int, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(row, data, none, none, np.zeros(len(bounds), np.int64))
    apart = separators[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = apart[:-1]
    inner = bounds[bounds < len(data)]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = apart[1:]
    ends = bounds[bounds > 0]
    after[ends - 1] = True
    word = ~apart
    start = np.flatnonzero(word & before)
    stop = np.flatnonzero(word & after) + 1
    return Words(row, data, start, stop, np.searchsorted(start, bounds))
