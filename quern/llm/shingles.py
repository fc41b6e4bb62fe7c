"""Word shingles of whole texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: A worker keeps the hashes of words it met among the last CACHE_WORDS to twice as many different ones.
CACHE_WORDS = 1 << 16
_words: dict[bytes, int] = {}
_former: dict[bytes, int] = {}
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    global _words, _former
    if len(_words) > CACHE_WORDS:
        _words, _former = {}, _words
    known, former = _words, _former
    for w in set(words).difference(known):
        known[w] = former[w] if w in former else xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def forget() -> None:
    """Empties the cache, which otherwise stays with a worker that Spark uses again for other work."""
    global _words, _former
    _words, _former = {}, {}


def split(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, with A-Z lower-cased; bytes.split() without arguments knows the six ASCII blanks alone."""
    return text.lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles; with fewer words than a shingle has, their sequence is one; without words, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width_here = min(width, n)
    out = np.full(n - width_here + 1, width_here, np.uint64)
    for k in range(width_here):
        out = mix(out * _MULTIPLIER + h[k : n - width_here + 1 + k])
    return np.unique(out)
