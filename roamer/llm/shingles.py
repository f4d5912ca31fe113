"""Vectorised word and shingle hashes of many texts at once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

WORDS_A_SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(z: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Byte codes for the rolling hash: A-Z have the codes of a-z.
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_TURN = mix64(np.arange(1001, 1001 + WORDS_A_SHINGLE, dtype=np.uint64)) | np.uint64(1)


#: Powers are kept for so many places; longer texts go block by block.
_BLOCK_BITS = 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 1 << _BLOCK_BITS
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def prefix_hash(raw: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span of bytes."""
    up, _ = _powers()
    block = len(up)
    out = np.zeros(len(raw) + 1, np.uint64)
    for a in range(0, len(raw), block):
        part = np.cumsum(codes[raw[a:a + block]] * up[:len(raw) - a])
        if a:
            part *= np.uint64(pow(int(_BASE), a, 1 << 64))
        out[a + 1:a + 1 + len(part)] = part + out[a]
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they lie."""
    _, down = _powers()
    back = down[start & (len(down) - 1)]
    if len(prefix) > len(down):
        steps = np.array([pow(int(_INVERSE), a, 1 << 64) for a in range(0, len(prefix), len(down))], np.uint64)
        back = back * steps[start >> _BLOCK_BITS]
    return mix64((prefix[stop] - prefix[start]) * back + (stop - start).astype(np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of every text, the sorted distinct 64-bit hashes of its 5-word shingles (A-Z lower-cased);
    with fewer words, one hash of them all; without words, none."""
    n = len(offsets) - 1
    raw = raw[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return [np.empty(0, np.uint64)] * n
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    start, stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    h = span_hash(prefix_hash(raw, _LOWER), start, stop)
    first = np.searchsorted(start, offsets)
    k = WORDS_A_SHINGLE
    total = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        total += h[i:len(h) - k + 1 + i] * _TURN[i]
    total = mix64(total)
    out = []
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(total[a:b - k + 1]))
        elif b > a:
            out.append(mix64(np.sum(h[a:b] * _TURN[:b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """128-bit key of a set of hashes; empty sets have none."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Bits, four a token or more, of which each says whether an odd number of tokens fall on it."""
    bits = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference: every differing bit has a token
    that only one of them has. The finer sketch is folded to the coarser one's bits."""
    x, y = (np.frombuffer(s, "<u8") for s in (a, b))
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())
