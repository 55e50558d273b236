"""Hashes of words and word shingles.

Words are runs of bytes other than space and 0x09-0x0D; A-Z counts as a-z. In sets a word's hash is
its xxhash64, and a shingle's hash mixes its words' hashes. Sets are compared by these 64-bit values:
two different shingles of a pair of documents of 10,000 words each are confused with probability 10^-11.
``words`` and ``word_hashes`` serve the features of passages, where a confusion decides nothing: the
latter is a polynomial over random values of the bytes, modulo 2^64, taken from running sums.
"""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW = 1 << 20
MEMO = 200_000
ONE_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _values(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BYTE = _values(256, 1000)
BYTE[65:91] = BYTE[97:123]
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
FACTORS = _values(64, 7) | U64(1)


class Powers:
    def __init__(self, base: int) -> None:
        self.base, self.known = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, WINDOW + 1), self.base, U64)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known[:n]


POWERS, INVERSES = Powers(BASE), Powers(INVERSE)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the first word of each row (one more entry than rows)."""
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # rows part words too
    before, after = np.concatenate([[False], solid]), np.concatenate([solid, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + WINDOW)))
        size = int(ends[j - 1] - base)
        sums = np.zeros(size + 1, U64)
        np.cumsum(BYTE[raw[base : base + size]] * POWERS.upto(size), out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * INVERSES.upto(size + 1)[a]
        i = j
    return mix(out + (ends - starts).astype(U64) * FACTORS[-1])


class WordHashes(dict):
    """xxhash64 of words, A-Z as a-z; those of recent short words are remembered, within ``MEMO`` entries of 32 bytes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """The hash of every word of a text; a long text is split piece by piece."""
        text = text.lower()
        if len(text) <= WINDOW:
            return np.fromiter(map(self.__getitem__, words := text.split()), U64, len(words))
        text, out, at = text.translate(ONE_SPACE), [], 0
        while at < len(text):
            stop = len(text) if at + WINDOW >= len(text) else text.rfind(b" ", at, at + WINDOW) + 1 or text.find(b" ", at + WINDOW) + 1 or len(text)
            out.append(np.fromiter(map(self.__getitem__, words := text[at:stop].split()), U64, len(words)))
            at = stop
        return np.concatenate(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_sets(texts: list[bytes], n: int, hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer words has its whole sequence as one."""
    rows = list(map(hashes.of, texts))
    ends = np.cumsum([0, *map(len, rows)]).tolist()
    h = np.concatenate([np.zeros(0, U64), *rows])
    if len(h) >= n:
        joined = h[: len(h) - n + 1] * FACTORS[0]
        for k in range(1, n):
            joined = joined + h[k : len(h) - n + 1 + k] * FACTORS[k]
        joined = mix(joined)
    out = []
    for a, b in zip(ends, ends[1:]):
        if b - a >= n:
            out.append(distinct(joined[a : b - n + 1]))
        elif b > a:
            out.append(mix((h[a:b] * FACTORS[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(h[:0])
    return out
