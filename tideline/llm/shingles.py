"""Sets of hashed word triples, computed for many texts at once with array operations.

Words are the runs of letters and digits of the lower-cased text. A word's hash is a polynomial over its characters,
taken from one running sum over all texts; a triple's hash mixes three words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bits of a triple's hash; the bits above hold a text's number in its batch.
BITS = 44
_MASK = np.uint64((1 << BITS) - 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
#: Characters handled at once, which bounds the arrays' memory (one text is never cut).
CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _is_word() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 modulo 2**64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHARS + CHARS // 4)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def triples(texts: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash of BITS bits), sorted and distinct; texts of different seeds share no hashes."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower))
    codes = np.frombuffer(("\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _is_word()[np.minimum(codes, 0x10FFFF)]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.r_[0, edge]
    first, last = edge[0::2], edge[1::2]
    p, q = powers(len(codes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], dtype=np.uint64)])
    h = mix((total[last] - total[first]) * q[first] + np.uint64(0x2545F4914F6CDD1D))
    text = np.searchsorted(np.cumsum(sizes), first, "right")
    if len(h) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    same = text[2:] == text[:-2]
    seed = mix(np.asarray(seeds, np.uint64) + np.uint64(77))
    t = mix(h[:-2] * np.uint64(0xD6E8FEB86659FD93) + mix(h[1:-1] + np.uint64(1)) * np.uint64(3) + h[2:] * np.uint64(0xA0761D6478BD642F) + seed[text[:-2]])
    both = np.unique((text[:-2][same].astype(np.uint64) << np.uint64(BITS)) | (t[same] & _MASK))
    return (both >> np.uint64(BITS)).astype(np.int64), both & _MASK


def batches(texts: list[str], seeds: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, text number within it, hash) over slices of about CHARS characters."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= CHARS):
            n += len(texts[hi])
            hi += 1
        yield lo, hi, *triples(texts[lo:hi], seeds[lo:hi])
        lo = hi


def fingerprints(text: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of triples, 64-bit fingerprint of the set) of each text; 0 triples have fingerprint 0."""
    n = np.bincount(text, minlength=n_texts)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    out = np.zeros(n_texts, np.uint64)
    some = n > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(h + np.uint64(5)), start[some]) ^ (n[some].astype(np.uint64) << np.uint64(50)))
    return n, out.view(np.int64)
