"""Sets of word shingles as 64-bit hashes."""

import numpy as np
import xxhash

MAX_CACHED_WORDS = 50_000  # the frequent words of a corpus; rarer ones are hashed again
LONGEST_CACHED = 64  # bytes; a longer run without white space is hashed each time


class WordHashes(dict):
    """Hashes of words seen by this task; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= MAX_CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct ``width``-word shingles of a whole text.

    Words are runs of characters other than ASCII white space, A-Z in lower case.
    Fewer words than ``width`` are one shingle; no words are an empty set.
    """
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(width, n)
    rows = n - width + 1
    out = np.full(rows, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + rows])
    return np.unique(out)
