"""Whole texts as sets of hashed word shingles, a batch of texts at a time."""

from __future__ import annotations

import numpy as np

from sunmesh.llm.common import keeps, only

#: Words that a worker remembers before it starts again, and the longest that it remembers, in bytes.
REMEMBERED, LONGEST = 700_000, 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_31, _29, _32 = np.uint64(31), np.uint64(29), np.uint64(32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> _31)


class _Words(dict):
    def __missing__(self, word):
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = value
        return value


_words = _Words()
keeps("shingles", _words.clear)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, with A-Z in lower case, and the number of words of each text."""
    only("shingles")
    if len(_words) > REMEMBERED:
        _words.clear()
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.encode().lower().split() if text else ()
        counts[i] = len(own)
        words.extend(own)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)), counts


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, one set after the other, and the sets' sizes.

    A text of fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    words, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    # Combine each word with the next ones; what runs over a text's end is left out below.
    mixed = words.copy()
    with np.errstate(over="ignore"):
        for j in range(1, min(width, len(words))):
            mixed[: len(words) - j] = (mixed[: len(words) - j] ^ (mixed[: len(words) - j] >> _29)) * _A + words[j:]
        mixed = mix64(mixed + np.uint64(width))
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            x = words[first[i]]
            for j in range(1, counts[i]):
                x = (x ^ (x >> _29)) * _A + words[first[i] + j]
            mixed[first[i]] = mix64(np.array([x + np.uint64(counts[i])], np.uint64))[0]
    sets, own = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for i, (a, n) in enumerate(zip(first, sizes)):
        if n:
            h = np.sort(mixed[a : a + n])
            if n > 1:
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
            own[i] = len(h)
            sets.append(h)
    return np.concatenate(sets), own


def fingerprints(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit name per set; sets with the same shingles have the same."""
    ends = np.concatenate([[np.uint64(0)], np.cumsum(mix64(sets ^ _A), dtype=np.uint64)])
    stop = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        return mix64(ends[stop] - ends[stop - sizes] + sizes.astype(np.uint64) * _C)
