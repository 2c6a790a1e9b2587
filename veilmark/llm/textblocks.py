"""Vectorised hashing of words and word shingles for blocks of texts.

Texts are lower-cased on A-Z only and split on the six ASCII white-space bytes, so a word is a run of
``[^\\x20\\x09-\\x0D]+``.  Hashes are 64-bit.  `WordBlock` (scorers' features) uses a byte polynomial
modulo 2**64 with an odd base, then a mixing step; `word_hashes` and `shingle_sets` (joins) mix eight bytes at a time instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK_BYTES, READ_ROWS = 250_000, 100
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 4 * BLOCK_BYTES:  # one very long text: don't keep its tables
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def blocks(texts: pa.Array):
    """Yield (first, last, bytes of each text) so that a block has about BLOCK_BYTES; a longer text is a block alone."""
    first, size, held = 0, 0, []
    each = (text for at in range(0, len(texts), READ_ROWS) for text in texts.slice(at, READ_ROWS).to_pylist())
    for i, text in enumerate(each):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BLOCK_BYTES:
            yield first, i, held
            first, size, held = i, 0, []
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, len(texts), held


class WordBlock:
    """The words of a block: `start`/`end` byte offsets, `hashes`, and `offsets` of each text's words."""

    def __init__(self, raws: list[bytes], lower: bool = True):
        joined = b"\n".join(raws) + b"\n"
        self.raw = np.frombuffer(joined, dtype=np.uint8)
        joined = joined.translate(LOWER) if lower else joined
        self.bytes = data = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[0::2], edges[1::2]
        power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self._sums[1:])
        bounds = np.zeros(len(raws) + 1, dtype=np.int64)
        np.cumsum([len(r) + 1 for r in raws], out=bounds[1:])
        self.bounds = bounds
        self.offsets = np.searchsorted(self.start, bounds)
        self.hashes = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix64((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


_PLACES = mix64(np.arange(11, 43, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


LANES = 3  # words of up to 8 * LANES bytes are hashed together
_SEEDS = mix64(np.arange(101, 101 + LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)  # the low n bytes of a number


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]: 8 bytes at a time, each mixed in before the next, and BLAKE2 of long words.

    `data` must go on for 8 * LANES bytes after the last word.
    """
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    out = mix64(length.astype(np.uint64) * _SEEDS[LANES])
    for lane in range(LANES):
        some = np.flatnonzero(length > 8 * lane) if lane else slice(None)
        held = eight[start[some] + 8 * lane] & _KEEP[np.minimum(length[some] - 8 * lane, 8)]
        out[some] = mix64(out[some] ^ mix64(held * _SEEDS[lane] + np.uint64(lane)))
    for i in np.flatnonzero(length > 8 * LANES):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def shingle_sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    data = (b"\n".join(raws) + b"\n").translate(LOWER) + bytes(8 * LANES)
    space = _SPACE[np.frombuffer(data, dtype=np.uint8, count=len(data) - 8 * LANES)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[0::2], edges[1::2]
    words = word_hashes(data, start, end)
    bounds = np.zeros(len(raws) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=bounds[1:])
    at, n = np.searchsorted(start, bounds), len(words)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        mixed[: n - j] += words[j:] * _PLACES[j]
    mixed = mix64(mixed)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(_distinct(mixed[a : b - k + 1]))
        elif b > a:
            out.append(mix64(np.sum(words[a:b] * _PLACES[: b - a], keepdims=True) + _PLACES[k + b - a : k + b - a + 1]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
