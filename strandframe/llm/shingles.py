"""Hashed word n-grams of text batches; runs inside Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHED = 500_000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: words of more bytes are hashed one by one
_LONG = 256
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * K2
    return h ^ (h >> np.uint64(29))


class _Hashes(dict):
    """Word to hash; a new word is hashed when it is first looked up."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class WordHashes:
    """64-bit hashes of words, kept for words seen before up to a bound. Words are runs outside the six ASCII blanks, A-Z lowered."""

    def __init__(self):
        self.known = _Hashes()

    def words(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").lower().split()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _CACHED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of ``text``, as ``WordHashes`` tells words, eight bytes of all words at a time."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    padded = np.frombuffer(raw + bytes(9), dtype=np.uint8)
    letters = padded[: len(raw)]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = (letters != 32) & (letters - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = mixed(sizes.astype(np.uint64) * K1)
    h = mixed((h + (eights[starts] & _FIRST_BYTES[np.minimum(sizes, 8)])) * K1)
    at, done = np.flatnonzero(sizes > 8), 8
    while len(at) and done < _LONG:
        h[at] = mixed((h[at] + (eights[starts[at] + done] & _FIRST_BYTES[np.minimum(sizes[at] - done, 8)])) * K1)
        done += 8
        at = at[sizes[at] > done]
    for i in at.tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return h


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by the place of its first word."""
    n = len(hashes) - size + 1
    h = np.full(max(n, 0), size, dtype=np.uint64)
    for i in range(size):
        h = mixed((h + hashes[i : i + max(n, 0)]) * K1)
    return h


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct n-grams; a shorter text is one shingle, a text without words has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    found = np.sort(ngrams(hashes, min(size, len(hashes))).view(np.int64))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
