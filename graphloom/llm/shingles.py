"""Hashed word shingles of texts, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

_PLACE = np.random.default_rng(20240229).integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products become uniform."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Numbers of words that were seen, and 64-bit hashes of their bytes by number."""

    def __init__(self):
        self.hashes, self.fresh = np.zeros(0, dtype=np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(xxhash.xxh3_64_intdigest(word, 20240229))
        return number

    def of(self, texts: list[list[bytes]], n: int) -> np.ndarray:
        """Hashes of the ``n`` words of ``texts`` in order."""
        if len(self) > 1 << 18:
            self.clear()
            self.hashes = np.zeros(0, dtype=np.uint64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=n)
        if self.fresh:
            self.hashes = np.concatenate([self.hashes, np.array(self.fresh, dtype=np.uint64)])
            self.fresh = []
        return self.hashes[numbers]


def word_hashes(texts: list[bytes], seen: _Words) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, lower-cased in A-Z, and the number of words of each text.

    A word is a run of bytes other than space and \\x09-\\x0D. The hash depends on the word alone.
    """
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    return seen.of(words, int(counts.sum())), counts


def shingle_sets(texts, width: int = 5, group_bytes: int = 1 << 19) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    With fewer words the whole sequence is one shingle; a null text or one without words has none.
    """
    seen = _Words()  # of these texts alone: workers outlive their tasks, and would keep it
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > group_bytes:
            yield from _group_sets(held, width, seen)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield from _group_sets(held, width, seen)


def _group_sets(raw: list[bytes], width: int, seen: _Words) -> Iterator[np.ndarray]:
    words, counts = word_hashes(raw, seen)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += mix(words[k : k + len(rolled)] + _PLACE[k]) * _PLACE[width + k]
    rolled = mix(rolled)
    first = 0
    for n in counts:
        if n >= width:
            yield np.unique(rolled[first : first + n - width + 1])
        elif n:
            few = np.zeros(1, dtype=np.uint64)
            for k in range(n):
                few += mix(words[first + k : first + k + 1] + _PLACE[k]) * _PLACE[width + k]
            yield mix(few + np.uint64(n))
        else:
            yield np.zeros(0, dtype=np.uint64)
        first += n


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed longs in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)
