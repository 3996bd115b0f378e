"""Sets of word shingles as hashes, and their minwise sketches.

A word's hash is XXH3's over its bytes (128 bits), and a shingle's is the sum of its words' hashes, each times an odd number for its place, mixed: one of 64 bits
from each half. So unlike shingles share a hash no more often than random numbers do (a polynomial over bytes modulo
2^64 would not do: it has words that collide whatever its base). Sketches are made of the first halves; a set's name is made of both.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WORDS = 5
SKETCH = 128
BINS = 1024
_rng = np.random.Generator(np.random.PCG64(20240229))
PLACE = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
FACTOR = _rng.integers(0, 1 << 64, SKETCH, dtype=np.uint64) | np.uint64(1)
OFFSET = _rng.integers(0, 1 << 64, SKETCH, dtype=np.uint64)
PLACE_2 = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """A-Z are lower-cased, and words are what stands between spaces and the characters 9 to 13."""
    return (text or "").encode().lower().split()


def word_shingles(text: str | None, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """The shingles themselves: runs of `words` words, or all words if they are fewer; none without words."""
    said = words_of(text)
    n = min(words, len(said))
    return set(zip(*[said[k : len(said) - n + 1 + k] for k in range(n)]))


def halves(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each distinct shingle of a text, sorted by the first."""
    said = words_of(text)
    if not said:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, said)), "<u8").reshape(-1, 2)
    n = min(words, len(own))
    first, second = (sum(own[k : len(own) - n + 1 + k, half] * place[k] for k in range(n)) for half, place in ((0, PLACE), (1, PLACE_2)))
    first, second = mixed(first + np.uint64(n)), mixed(second + np.uint64(n))
    order = np.argsort(first)
    first, second = first[order], second[order]
    new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    return first[new], second[new]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The first hashes of a text's shingles, sorted."""
    return halves(text, words)[0]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The minwise values of a set that is not empty, as 32-bit numbers."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[at : at + 2048, None] * FACTOR + OFFSET).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def bins(hashes: np.ndarray) -> np.ndarray:
    """A finer sketch of a sorted set: of the smallest hash in each of BINS ranges one byte, 0 where a range is empty."""
    out = np.zeros(BINS, np.uint8)
    place = (hashes >> np.uint64(64 - 10)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out[place[first]] = (hashes[first] >> np.uint64(24)) % np.uint64(255) + np.uint64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of sets by their bins, over the last axis."""
    return ((a == b) & (a != 0)).sum(axis=-1) / np.maximum(((a | b) != 0).sum(axis=-1), 1)


def set_key(first: np.ndarray, second: np.ndarray | None = None) -> bytes:
    """128 bits that name a set, by both hashes of its shingles (or the first alone)."""
    return hashlib.blake2b(first.tobytes() + (b"" if second is None else second.tobytes()), digest_size=16).digest()


def alike(a: set, b: set, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
